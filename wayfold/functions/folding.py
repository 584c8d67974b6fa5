"""Script folding: texts and queries of several scripts of one language meet in common forms.

Conversion is greedy: at each place the longest phrase of a dictionary that fits is replaced, of equal ones
the first. Dictionaries are tables of the caller; none come with the library.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of all dictionaries together; they go to every task.
MOST = 200_000


class Phrases:
    """A dictionary of phrases with the longest phrase by first character."""

    def __init__(self, rows: Iterable[tuple[str, str]]) -> None:
        self.values: dict[str, str] = {}
        for key, value in rows:
            if key and value:
                self.values.setdefault(key, value)
        self.longest: dict[str, int] = {}
        for key in self.values:
            self.longest[key[0]] = max(len(key), self.longest.get(key[0], 0))

    def convert(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            for n in range(min(self.longest.get(text[at], 0), len(text) - at), 0, -1):
                value = self.values.get(text[at : at + n])
                if value is not None:
                    out.append(value)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)


class Folder:
    """The forms of a text: converted directly, and after a regional dictionary, if that gives another one."""

    def __init__(self, direct: Iterable[tuple[str, str]], regional: Iterable[tuple[str, str]] = ()) -> None:
        self.direct, self.regional = Phrases(direct), Phrases(regional)
        if len(self.direct.values) + len(self.regional.values) > MOST:
            raise ValueError(f"more than {MOST} phrases")

    @classmethod
    def of(cls, table: DataFrame) -> Folder:
        """table: kind ('direct' or 'regional'), ordinal, key, value, reversed (whether value is what is replaced by key)."""
        rows = table.orderBy("ordinal").limit(MOST + 1).collect()
        pairs = lambda kind: [(r.value, r.key) if r.reversed else (r.key, r.value) for r in rows if r.kind == kind]
        return cls(pairs("direct"), pairs("regional"))

    def variants(self, text: str) -> list[str]:
        if text.isascii():
            return [text]
        return list(dict.fromkeys([self.direct.convert(text), self.direct.convert(self.regional.convert(text))]))

    def forms(self, text: Column) -> Column:
        """The variants of a text column as an array; null counts as ''."""

        @F.arrow_udf("array<string>")
        def fold(texts: pa.Array) -> pa.Array:
            return pa.array([self.variants(t) for t in texts.to_pylist()], pa.list_(pa.string()))

        return fold(F.coalesce(text, F.lit("")))
