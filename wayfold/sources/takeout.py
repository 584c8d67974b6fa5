"""Export archives (ZIP) as a Spark data source: members listed from the archive's directory, records streamed out of each."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wayfold.sources.browsers import takeout_kind

#: Keys that hold the records of an export, and bytes of a member that tell what it is; fixed values.
ROOTS, SNIFF = ("BrowserHistory", "Browser History"), 64 * 1024
CHUNK = 1 << 20
MEMBERS, RECORDS = "archive string, path string, size long, head string", "archive string, path string, ordinal long, value string"


def _opened(path: str) -> tuple[object, str]:
    """File system and path of an archive; local paths and the stores that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    store, own = _opened(path)
    info = store.get_file_info(own)
    if info.type == fs.FileType.Directory:
        return sorted(i.path for i in store.get_file_info(fs.FileSelector(own, recursive=True)) if i.path.lower().endswith(".zip"))
    return [own]


class _Buffer:
    """Text of a stream as far as it is needed; what has been taken is let go."""

    def __init__(self, stream: io.TextIOBase, chunk: int) -> None:
        self.stream, self.chunk, self.text, self.at, self.over = stream, chunk, "", 0, False

    def more(self) -> bool:
        new = "" if self.over else self.stream.read(self.chunk)
        self.over = self.over or not new
        self.text, self.at = self.text[self.at :] + new, 0
        return bool(new)

    def peek(self) -> str:
        """The next character that isn't white space; '' at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n﻿":
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def value(self) -> str:
        """The JSON value that comes next, as it is written."""
        self.peek()
        decode = json.JSONDecoder().raw_decode
        while True:
            try:
                _, end = decode(self.text, self.at)
                if end < len(self.text) or not self.more():  # a number may go on in the next chunk
                    if end <= len(self.text) and (end < len(self.text) or self.over):
                        out, self.at = self.text[self.at : end], end
                        return out
            except json.JSONDecodeError:
                if not self.more():
                    raise

    def skip(self, wanted: str) -> bool:
        if self.peek() != wanted:
            return False
        self.at += 1
        return True


def records(stream: io.TextIOBase, lines: bool, chunk: int = CHUNK) -> Iterator[str]:
    """Records of a member: each line that isn't blank, or the values of an array, at the root or under one of ROOTS."""
    if lines:
        yield from (line.rstrip("\r\n") for line in stream if line.strip())
        return
    buffer = _Buffer(stream, chunk)
    inside = buffer.skip("[")
    if not inside and buffer.skip("{"):
        while buffer.peek() not in ("}", ""):
            key = json.loads(buffer.value())
            buffer.skip(":")
            if key in ROOTS and buffer.skip("["):
                inside = True
                break
            buffer.value()
            buffer.skip(",")
    while inside and buffer.peek() not in ("]", ""):
        yield buffer.value()
        buffer.skip(",")


@dataclass
class Member(InputPartition):
    archive: str
    path: str | None


class TakeoutReader(DataSourceReader):
    """One partition an archive when members are listed, one a member when records are read. Only columns of the schema are made."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.path = schema.fieldNames(), options["path"]
        self.wanted = json.loads(options["members"]) if "members" in options else None

    def partitions(self) -> list[Member]:
        if self.wanted is None:
            return [Member(a, None) for a in _archives(self.path)]
        return [Member(a, p) for a, p in self.wanted]

    def read(self, part: Member) -> Iterator[tuple]:
        store, own = _opened(self.path)
        with store.open_input_file(part.archive) as raw, zipfile.ZipFile(raw) as archive:
            if part.path is not None:
                plain = {"archive": part.archive, "path": part.path}
                with archive.open(part.path) as member, io.TextIOWrapper(member, "utf-8", errors="strict", newline=None) as text:
                    for ordinal, value in enumerate(records(text, part.path.lower().endswith(".jsonl"))):
                        row = plain | {"ordinal": ordinal, "value": value}
                        yield tuple(row[c] for c in self.columns)
                return
            for info in archive.infolist():
                if not info.is_dir():
                    head = archive.open(info).read(SNIFF).decode("utf-8", "replace") if "head" in self.columns and info.filename.lower().endswith(".json") else None
                    row = {"archive": part.archive, "path": info.filename, "size": info.file_size, "head": head}
                    yield tuple(row[c] for c in self.columns)


class TakeoutSource(DataSource):
    """Format ``takeout_zip``: path is an archive or a folder of them; ``members`` names those whose records are read."""

    @classmethod
    def name(cls) -> str:
        return "takeout_zip"

    def schema(self) -> str:
        return RECORDS if "members" in self.options else MEMBERS

    def reader(self, schema: StructType) -> TakeoutReader:
        return TakeoutReader(schema, dict(self.options))


def members(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, size, family, disposition, reason of every file of the archives; a JSON file that isn't known by its path is by its beginning."""
    spark.dataSource.register(TakeoutSource)
    kind = takeout_kind(F.col("path"))
    found = spark.read.format("takeout_zip").load(path).withColumn("kind", kind)
    known = F.col("kind.family").isin("jsonl", "browser-json", "typed-url-json", "session-json", "takeout-index")
    sniffed = ~known & F.contains("head", F.lit('"Browser History"')) & F.contains("head", F.lit('"time_usec"'))
    told = F.when(F.coalesce(sniffed, F.lit(False)), F.expr("named_struct('family', 'browser-json', 'disposition', 'will-import', 'reason', 'chrome-history-json')")).otherwise(F.col("kind"))
    return found.withColumn("kind", told).select("archive", "path", "size", "kind.*")


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Records (archive, path, ordinal, value, or some of these) of all files of the archives that are imported, for browsers.takeout()."""
    wanted = [(r.archive, r.path) for r in members(spark, path).where("disposition = 'will-import'").select("archive", "path").collect()]  # a line a file
    schema = ", ".join(c for c in RECORDS.split(", ") if not columns or c.split()[0] in columns)
    return spark.read.format("takeout_zip").schema(schema).option("members", json.dumps(wanted)).load(path)
