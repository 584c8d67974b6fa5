"""Lexical search: documents of URLs, weighted postings, queries of prefix terms with OR, aliases and grams."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import text
from wayfold.functions.folding import Folder
from wayfold.store import table

#: Fields of a document and their weights, in order; fixed values.
WEIGHTS = {"url": 6.0, "title": 12.0, "search_terms": 4.0, "normalized_url": 5.0, "normalized_title": 10.0, "normalized_terms": 4.0, "cjk": 2.0, "enrichment": 7.0, "notes": 9.0, "tags": 6.0}
ALIASES = {"gh": ("github",), "yt": ("youtube",), "pr": ("pull request",)}
K1, B, TRIGRAM_PENALTY = 1.2, 0.75, 0.35
#: Added to a fuzzy match by field; URLs and visits that a search for visits looks at; fixed values.
FUZZY = {"normalized_title": 0.0, "normalized_url": 0.08, "normalized_terms": 0.12, "compact": 0.2}
FUZZY_URLS, FUZZY_VISITS = 200, 400


def documents(url_rows: DataFrame, terms: DataFrame, notes: DataFrame, tags: DataFrame, enrichment: DataFrame, fold: Folder | None = None) -> DataFrame:
    """The search projection: one row a URL (doc_id, profile_id, url_id) with the fields of WEIGHTS and compact.

    terms: profile_id, url_id, term. notes: url, notes. tags: url, tag. enrichment: url, summary,
    metadata. Terms and tags are sorted; notes and tags fold into the compact text and the grams
    only, so that field filters don't look into them; size and windows are the numbers of tokens of all
    fields and of three-character windows of the compact text. With a folder, every field is indexed in each of its forms. Rows of some URLs are refreshed by giving
    only those.
    """
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), " ")
    t = terms.groupBy("profile_id", "url_id").agg(F.replace(joined("term"), F.lit(","), F.lit(" ")).alias("search_terms"))
    g = tags.groupBy("url").agg(joined("tag").alias("tags"))
    e = enrichment.select("url", text.enrichment_text(F.col("summary"), F.col("metadata")).alias("enrichment"))
    rows = url_rows.select("profile_id", "url_id", "url", "title").join(t, ["profile_id", "url_id"], "left").join(notes.select("url", "notes"), "url", "left").join(g, "url", "left").join(e, "url", "left")
    rows = rows.fillna("", ["title", "search_terms", "notes", "tags", "enrichment"])
    names = {"url": "url", "title": "title", "terms": "search_terms", "notes": "notes", "tags": "tags"}
    forms = lambda c: F.array(c) if fold is None else F.array_distinct(F.transform(fold.forms(c), F.lower))
    rows = rows.withColumns({f"forms_{n}": forms(text.normalize_text(F.col(c))) for n, c in names.items()})
    parts = F.filter(F.transform(F.concat(*[f"forms_{n}" for n in names]), text.compact), lambda p: p != "")
    rows = rows.withColumns({"compact": F.array_join(parts, " "), **{f"normalized_{n}": F.array_join(f"forms_{n}", " ") for n in names}}).drop(*[f"forms_{n}" for n in names])
    rows = rows.withColumn("cjk", F.array_join(text.han_grams(F.col("compact")), " ")).withColumn("doc_id", F.concat_ws(":", "profile_id", F.col("url_id").cast("string"))).drop("normalized_notes", "normalized_tags")
    size = sum((F.size(tokens(F.col(f))) for f in WEIGHTS), F.lit(0))
    return rows.withColumn("size", size.cast("int")).withColumn("windows", F.greatest(F.char_length("compact") - 2, F.lit(0)))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def index(docs: DataFrame) -> DataFrame:
    """token, doc_id, weight (of all its occurrences, by field), size (tokens of the document): no shuffle, sorted by token when stored."""

    def weighted(field: str, w: float) -> Column:  # a default argument of the lambda would be taken for the element's index
        return F.transform(tokens(F.col(field)), lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))

    fields = [weighted(f, w) for f, w in WEIGHTS.items()]
    flat = docs.select("doc_id", F.concat(*fields).alias("t")).withColumn("size", F.size("t"))
    once = flat.withColumn("token", F.explode(F.array_distinct(F.transform("t", lambda x: x.token))))
    weight = F.aggregate(F.filter("t", lambda x: x.token == F.col("token")), F.lit(0.0), lambda a, x: a + x.w)
    return once.select("token", "doc_id", weight.alias("weight"), "size")


def gram_index(docs: DataFrame) -> DataFrame:
    """gram, doc_id, place, windows: a row for each three-character window of the compact text, no shuffle, sorted by gram when stored."""
    places = F.when(F.col("windows") > 0, F.sequence(F.lit(1), F.col("windows"))).otherwise(F.array().cast("array<int>"))
    return docs.select("doc_id", "compact", "windows", F.explode(places).alias("place")).select(F.substring("compact", F.col("place"), F.lit(3)).alias("gram"), "doc_id", "place", "windows")


def gram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Index:
    """What a search reads: documents, postings by token, windows by gram, windows counted by gram, and three totals."""

    docs: DataFrame
    postings: DataFrame
    grams: DataFrame
    counts: DataFrame
    n: int
    size: int
    windows: int


def totals(docs: DataFrame) -> tuple[int, int, int]:
    """Documents, tokens and windows; they add up over parts of a collection."""
    row = docs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("windows"), F.lit(0))).first()
    return row[0], row[1], row[2]


@dataclass(frozen=True)
class Lexical:
    """Alternatives of terms that must all occur (a term with * as a prefix), compact texts to be contained, and targets for fuzzy matches."""

    alternatives: tuple[tuple[str, ...], ...]
    compacts: tuple[str, ...]
    targets: tuple[str, ...]


_HAN = re.compile(f"[{text.HAN}]".replace("\\x{20000}-\\x{2ebef}\\x{30000}-\\x{3134f}", "\U00020000-\U0002ebef\U00030000-\U0003134f"))


def analyze(query: str, fold: Folder | None = None) -> Lexical:
    """With a folder, each form of a segment is an alternative. OR separates segments; of each, words are prefixes and ideographs pairs and triples, all of which must occur; aliases are alternatives."""
    segments, current = [], []
    for word in query.split():
        if word.lower() == "or":
            segments, current = ([*segments, current], []) if current else (segments, current)
        else:
            current.append(word)
    alternatives, compacts, targets = [], [], []

    def put(to: list, value) -> None:
        if value and value not in to:
            to.append(value)

    for words in [*segments, current]:
        plain = unicodedata.normalize("NFKC", " ".join(words).replace("\0", ""))
        variants: list[str] = []
        for normal in dict.fromkeys(x.lower() for x in (fold.variants(plain) if fold else [plain])):
            compact = "".join(c for c in normal if c.isalnum())
            variants += [normal, *ALIASES.get(compact, ())] if compact else []
        for variant in dict.fromkeys(variants):
            own = "".join(c for c in variant if c.isalnum())
            latin = sorted({w for w in re.split(r"[\W_]+", variant) if w and not all(_HAN.match(c) for c in w)})
            runs = re.findall(f"{_HAN.pattern}+", own)
            grams = sorted({r[i : i + n] for r in runs for n in (2, 3) for i in range(len(r) - n + 1)})
            put(alternatives, (*[f"{w}*" for w in latin], *grams))
            put(compacts, own if len(own) >= 3 else "")
            put(targets, own if 4 <= len(own) <= 64 and own.isascii() and any(c.isalpha() for c in own) else "")
    return Lexical(tuple(alternatives), tuple(compacts), tuple(targets))


def idf(n: Column, docs: int) -> Column:
    return F.greatest(F.log((docs - n + 0.5) / (n + 0.5)), F.lit(1e-6))


def bm25(df: Column, f: Column, size: Column, n: int, mean: float) -> Column:
    return idf(df, n) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))


def occurrences(index: Index, compact: str) -> DataFrame:
    """doc_id, size, f: documents that contain a compact text, and how often (side by side), by their windows alone.

    Windows three apart (and the last) cover the text, so a place where all of them lie at their distance
    is an occurrence. The documents of the rarest one are found first; of the others only windows of these
    are moved.
    """
    offsets: dict[str, list[int]] = {}
    for i in sorted({*range(0, len(compact) - 2, 3), len(compact) - 3}):
        offsets.setdefault(compact[i : i + 3], []).append(i)
    need = sum(map(len, offsets.values()))
    count = {r.gram: r.n for r in index.counts.where(F.col("gram").isin(*offsets)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a line a window of the query
    rarest = min(offsets, key=lambda g: (count.get(g, 0), g))
    found = index.grams.where(F.col("gram").isin(*offsets))
    if len(offsets) > 1:
        found = found.join(index.grams.where(F.col("gram") == rarest).select("doc_id").distinct(), "doc_id", "left_semi")
    at = F.coalesce(*[F.when(F.col("gram") == g, F.array(*[F.lit(i) for i in own])) for g, own in offsets.items()])
    starts = found.select("doc_id", F.col("windows").alias("size"), "place", F.explode(at).alias("off")).groupBy("doc_id", (F.col("place") - F.col("off")).alias("start"), "size").agg(F.count("*").alias("met"))
    starts = starts.where(F.col("met") == need).groupBy("doc_id", "size").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    none = F.struct(F.lit(0).alias("f"), F.lit(0).alias("end"))
    step = lambda a, x: F.when(x >= a.end, F.struct((a.f + 1).alias("f"), (x + len(compact)).cast("int").alias("end"))).otherwise(a)
    return starts.select("doc_id", "size", F.aggregate("starts", none, step, lambda a: a.f).cast("double").alias("f"))


def scored(index: Index, q: Lexical) -> DataFrame:
    """doc_id, score of matching documents, the least score being the best.

    Terms score by weighted BM25 over all terms of the query, documents that hold all terms of an
    alternative match; a contained compact text scores by BM25 of its occurrences among three-character
    windows, and a penalty. Of both, the less counts. Read are the postings of the query's terms and
    windows (both sorted, so a scan leaves out the rest), and no documents.
    """
    mean, wide = index.size / max(index.n, 1) or 1.0, index.windows / max(index.n, 1) or 1.0
    terms = sorted({t for a in q.alternatives for t in a})
    fits = lambda t: F.startswith(F.col("token"), F.lit(t[:-1])) if t.endswith("*") else F.col("token") == t
    out = None
    if terms:
        met = F.array_compact(F.array(*[F.when(fits(t), F.lit(t)) for t in terms]))
        hits = index.postings.where(reduce(or_, map(fits, terms))).select("doc_id", "weight", "size", F.explode(met).alias("term"))
        hits = hits.groupBy("doc_id", "term").agg(F.sum("weight").alias("f"), F.first("size").alias("size"))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a line a term of the query
        part = bm25(F.col("df"), F.col("f"), F.col("size"), index.n, mean)
        by_doc = hits.join(F.broadcast(df), "term").groupBy("doc_id").agg((-F.sum(part)).alias("score"), F.collect_set("term").alias("met"))
        whole = [F.size(F.array_except(F.array(*[F.lit(t) for t in a]), F.col("met"))) == 0 for a in q.alternatives]
        out = by_doc.where(reduce(or_, whole)).select("doc_id", "score")
    if q.compacts:
        found = reduce(DataFrame.unionByName, [occurrences(index, c).withColumn("c", F.lit(c)) for c in q.compacts])
        df = found.groupBy("c").agg(F.count("*").alias("df"))  # a line a text of the query
        part = bm25(F.col("df"), F.col("f"), F.col("size"), index.n, wide)
        near = found.join(F.broadcast(df), "c").groupBy("doc_id").agg((-F.sum(part) + TRIGRAM_PENALTY).alias("score"))
        out = near if out is None else out.unionByName(near)
    return out.groupBy("doc_id").agg(F.round(F.min("score"), 9).alias("score"))


def fuzzy_candidates(index: Index, q: Lexical, most: int = FUZZY_URLS) -> DataFrame:
    """doc_id, near: the ``most`` documents that share most with the targets, by BM25 of their windows (the least is the best)."""
    grams = sorted({t[i : i + 3] for t in q.targets for i in range(len(t) - 2)})
    hits = index.grams.where(F.col("gram").isin(*grams)).groupBy("doc_id", "gram").agg(F.count("*").alias("f"), F.first("windows").alias("size"))
    df = hits.groupBy("gram").agg(F.count("*").alias("df"))  # a line a window of the query
    part = bm25(F.col("df"), F.col("f"), F.col("size"), index.n, index.windows / max(index.n, 1) or 1.0)
    near = hits.join(F.broadcast(df), "gram").groupBy("doc_id").agg(F.round(-F.sum(part), 9).alias("near"))
    return near.orderBy("near", "doc_id").limit(most)


def _edits(target: str) -> int:
    """Edits between a target and a word that is near to it."""
    return 1 if len(target) <= 5 else 2 if len(target) <= 9 else 3 if len(target) <= 16 else 4


def fuzzy(index: Index, q: Lexical, most: int | None = None) -> DataFrame:
    """doc_id, score (and near, with most) when nothing matches: distance of a target to a word of a field as a share of the longer, and the field's penalty.

    Words of the compact text are its windows of about the target's length. All documents are scored; those that can't
    hold a near word, as they share no window with a target whose length leaves one whole, are passed over first. With
    ``most``, only the documents of fuzzy_candidates are, with their place among these as near.
    """
    columns = ["doc_id", "near", "score"] if most else ["doc_id", "score"]
    if not q.targets:
        return index.docs.select("doc_id", F.lit(0.0).alias("near"), F.lit(0.0).alias("score")).limit(0).select(columns)
    if most:
        near = fuzzy_candidates(index, q, most).collect()  # a bounded number
        docs = index.docs.where(F.col("doc_id").isin([r.doc_id for r in near]))
    elif all(len(t) - 2 - 3 * _edits(t) >= 1 for t in q.targets):
        docs = index.docs.where(reduce(or_, [F.contains("compact", F.lit(g)) for g in sorted({t[i : i + 3] for t in q.targets for i in range(len(t) - 2)})]))
    else:
        docs = index.docs
    every = []
    for target in q.targets:
        limit = _edits(target)

        def score(words: Column, penalty: float, target: str = target, limit: int = limit) -> Column:
            d = F.transform(words, lambda w: F.struct(F.levenshtein(F.lit(target), w, limit).alias("d"), F.greatest(F.char_length(w), F.lit(len(target))).alias("n")))
            return F.array_min(F.transform(F.filter(d, lambda x: x.d >= 0), lambda x: x.d / x.n + penalty))

        cuts = [F.flatten(F.transform(F.split("compact", " "), text.windows(k))) for k in range(max(len(target) - 2, 4), len(target) + 3)]
        every += [score(tokens(F.col(f)), p) for f, p in FUZZY.items() if f != "compact"] + [score(F.array_distinct(F.concat(*cuts)), FUZZY["compact"])]
    found = docs.select("doc_id", F.round(F.array_min(F.array_compact(F.array(*every))), 9).alias("score")).where("score IS NOT NULL")
    if not most:
        return found
    ranks = index.docs.sparkSession.createDataFrame([(r.doc_id, r.near) for r in near], "doc_id string, near double")
    return found.join(ranks, "doc_id").select("doc_id", "near", "score")


def fuzzy_visits(found: DataFrame, visits: DataFrame, most: int = FUZZY_VISITS) -> DataFrame:
    """visits (doc_id, ms, visit_id) of fuzzy matches with their score: the ``most`` of the nearest documents, newest first, are looked at."""
    return visits.join(found, "doc_id").orderBy("near", F.desc("ms"), F.desc("visit_id")).limit(most).drop("near")


def search(index: Index, query: str, fold: Folder | None = None) -> DataFrame:
    """doc_id, score: lexical matches, or fuzzy ones if there is none. fold: what the documents were folded by."""
    q = analyze(query, fold)
    if not q.alternatives and not q.compacts:
        return fuzzy(index, q)
    found = table(scored(index, q), "lexical-found")
    return fuzzy(index, q) if found.isEmpty() else found
