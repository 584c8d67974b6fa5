"""How sources of a language diverge: tries of terms merged by prefix range, walked for pairs of sources and telling terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.store import table
from wayfold.llm.tokens import LOWER, slices, word_bounds
from wayfold.llm.tries import PIECE, Trie, binary, merged, summed, unpacked

#: Production parameters: documents that a kept term is in, ranks of terms, the unit of shares.
DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Bytes of text that a task counts before it writes its tries out; bytes of the first prefixes; counters of a prefix
#: range at least, and ranges a shuffle partition; depth down to which ranges are refined, and leaves that a node needs for it.
TEXT_BYTES, PREFIX, LEAST_RANGE, RANGES, DEEP, NODE = 48 << 20, 2, 1 << 14, 4, 12, 64
#: Counters of kept terms that a task walks, about.
WALK = 1 << 20
#: Bytes that are no part of terms.
BREAK = np.ones(256, bool)
BREAK[65:91] = BREAK[97:123] = BREAK[128:] = False
_NODES = ", nodes array<struct<prefix:binary,counters:long>>"


def _counted(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a text column: terms, and for each row and term of it the row, the term's number and occurrences."""
    for first, data, off in slices(texts):
        start, end, row = word_bounds(data, off, BREAK)
        if not len(start):
            continue
        coded = binary(LOWER[data[~BREAK[data]]], end - start).dictionary_encode()
        size = len(coded.dictionary)
        key, n = summed(row * size + coded.indices.to_numpy(), np.ones(len(row), np.int64))
        yield coded.dictionary, key // size + first, key % size, n


def _flush(held: dict[str, list], names: dict[str, int]) -> Iterator[pa.RecordBatch]:
    known = list(names)
    for lang, found in held.items():
        trie = merged(found)
        terms = trie.terms.to_pylist()
        width = np.diff(np.searchsorted(trie.at, np.arange(len(terms) + 1)))
        keys = [t[:PREFIX] for t in terms]
        rows = []
        for row, (a, z) in zip(trie.pieces(lang, known, keys), trie.cuts(keys), strict=True):
            nodes: dict[bytes, int] = {}
            for depth in range(PREFIX, DEEP):
                at = [t[:depth] for t in terms[a:z]] if z - a >= NODE else []
                heavy = [(i, j) for i, j in trie.cuts(at) if j - i >= NODE]
                if not heavy:
                    break
                nodes.update((at[i], int(width[a + i : a + j].sum())) for i, j in heavy)
            rows.append(row | {"nodes": [{"prefix": k, "counters": v} for k, v in nodes.items()]})
        yield _batch(rows, with_nodes=True)
    held.clear()
    names.clear()


def _batch(rows: list[dict], with_nodes: bool = False) -> pa.RecordBatch:
    kinds = [("lang", pa.string()), ("prefix", pa.binary()), ("counters", pa.int64()), ("sources", pa.list_(pa.string()))]
    kinds += [(f, pa.binary()) for f in ("shared", "length", "tails", "docs", "width", "code", "n")]
    kinds += [("nodes", pa.list_(pa.struct([("prefix", pa.binary()), ("counters", pa.int64())])))] * with_nodes
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) -> subtries of what a task has counted, one a language and prefix."""
    held: dict[str, list] = {}
    names: dict[str, int] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        lang_of, kinds = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        codes = np.array([names.setdefault(s, len(names)) for s in sources.dictionary.to_pylist()], np.int64)
        for terms, row, leaf, n in _counted(batch.column(2)):
            for k in np.unique(lang_of[row]).tolist():
                mine = lang_of[row] == k
                code = codes[sources.indices.to_numpy()[row[mine]]]
                wide = int(code.max()) + 1
                key, docs, many = summed(leaf[mine] * wide + code, np.ones(len(code), np.int64), n[mine])
                used, at = np.unique(key // wide, return_inverse=True)
                _, docs = summed(at, docs)
                held.setdefault(kinds[k], []).append((terms.take(pa.array(used)), docs, at, key % wide, many))
        size += batch.nbytes
        if size >= TEXT_BYTES:
            yield from _flush(held, names)
            size = 0
    yield from _flush(held, names)


def _ranged(batches: Iterator[pa.RecordBatch], split: set[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Subtries cut again below the nodes of ``split``: a term's range is its shortest prefix that isn't one."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            lang = row["lang"]
            if (lang, row["prefix"]) not in split:
                rows.append(row)
                continue
            codes: dict[str, int] = {}
            trie, keys = Trie(*unpacked(row, codes)), []
            for term in trie.terms.to_pylist():
                depth = PREFIX
                while (lang, term[:depth]) in split and depth < len(term):
                    depth += 1
                keys.append(term[:depth])
            rows += trie.pieces(lang, list(codes), keys)
        yield _batch(rows)


def _kept(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Subtries in the order of their ranges -> one row a range: its terms of enough documents and their counters."""
    held, codes, last = [], {}, None

    def done() -> Iterator[pa.RecordBatch]:
        trie = merged(held)
        keep = trie.docs >= least
        if keep.any():
            place = np.cumsum(keep) - 1
            own = keep[trie.at]
            used, code = np.unique(trie.code[own], return_inverse=True)
            names, n = list(codes), trie.n[own]
            _, totals = summed(code, n)
            cols = [[last[0]], [trie.terms.filter(pa.array(keep)).to_pylist()], [place[trie.at[own]]], [code], [n], [[names[c] for c in used]], [totals]]
            many = pa.list_(pa.int64())
            kinds = [pa.string(), pa.list_(pa.binary()), many, many, many, pa.list_(pa.string()), many]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "terms", "at", "code", "n", "sources", "totals"])

    for batch in batches:
        for row in batch.to_pylist():
            if (row["lang"], row["prefix"]) != last:
                if held:
                    yield from done()
                held, codes, last = [], {}, (row["lang"], row["prefix"])
            held.append(unpacked(row, codes))
    if held:
        yield from done()


def kept_terms(docs: DataFrame, lang: str, source: str, text: str, least: int) -> DataFrame:
    """Rows of lang, terms (binary, in byte order), at, code, n (counters), sources and totals: one a prefix range."""
    spark = docs.sparkSession
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    pieces = table(docs.select(*named).mapInArrow(_pieces, PIECE + _NODES), "tries")
    # ranges hold a share of all counters each, so that there are only so many nodes above them a partition, whatever the data
    total = pieces.agg(F.sum("counters")).first()[0] or 0
    most = max(LEAST_RANGE, total // (RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    nodes = pieces.select("lang", F.explode("nodes").alias("node")).groupBy("lang", "node.prefix").agg(F.sum("node.counters").alias("counters"))
    split = {(r.lang, bytes(r.prefix)) for r in nodes.where(F.col("counters") > most).collect()}
    ranged = pieces.drop("nodes").mapInArrow(lambda b: _ranged(b, split), PIECE)
    dealt = ranged.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    kinds = "lang string, terms array<binary>, at array<long>, code array<long>, n array<long>, sources array<string>, totals array<long>"
    return table(dealt.mapInArrow(lambda b: _kept(b, least), kinds), "terms")


def _share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact for counts of any size."""
    if count.size and int(count.max()) >= (1 << 62) // UNIT:
        count = count.astype(object)
    return (1 + UNIT * (count + 1) // total).astype(np.int64)


def _walk(batches: Iterator[pa.RecordBatch], ranks: int) -> Iterator[pa.RecordBatch]:
    """Ranges of terms with their language's sources -> this task's sums of pairs and its best terms a source."""
    pairs: dict[tuple, np.ndarray] = {}
    best: dict[tuple, list[tuple[int, bytes]]] = {}
    heads: dict[str, list[str]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            lang, vocabulary = row["lang"], row["v"]
            heads[lang] = names = [h["source"] for h in row["heads"]]
            place = {s: i for i, s in enumerate(names)}
            totals = np.array([h["n"] for h in row["heads"]], np.int64) + vocabulary
            at, n = np.array(row["at"]), np.array(row["n"])
            code = np.array([place[s] for s in row["sources"]])[row["code"]]
            sums = pairs.setdefault(lang, np.zeros((len(names),) * 2, np.int64))
            step = max(1, (1 << 20) // len(names))
            for a in range(0, len(row["terms"]), step):
                terms = row["terms"][a : a + step]
                mine = slice(*np.searchsorted(at, [a, a + step]))
                count = np.zeros((len(terms), len(names)), np.int64)
                count[at[mine] - a, code[mine]] = n[mine]
                p, q = _share(count, totals), _share(count.sum(1), row["total"] + vocabulary)[:, None]
                value = np.where((count > 0) & (p > q), (p - q) ** 2 // q, -1)
                for i, name in enumerate(names):
                    sums[i] += ((p[:, i : i + 1] - p) ** 2 // p).sum(0)
                    told = np.flatnonzero(value[:, i] >= 0)
                    told = told[np.argsort(-value[told, i], kind="stable")[:ranks]]  # the walk's order settles ties
                    if len(told):
                        held = best.get((lang, name), []) + [(-int(value[j, i]), terms[j]) for j in told.tolist()]
                        best[lang, name] = sorted(held)[:ranks]
    out = [(lang, a, "pair", b.encode(), int(sums[i, j])) for lang, sums in pairs.items() for i, a in enumerate(heads[lang]) for j, b in enumerate(heads[lang]) if i != j]
    out += [(lang, name, "term", term, -value) for (lang, name), found in best.items() for value, term in found]
    cols = list(zip(*out, strict=True)) or [[]] * 5
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = DOCS, ranks: int = RANKS) -> DataFrame:
    """Return lang, source, part, item, value, rank: how far each source is from the others, and by which terms.

    A term is a run of letters A-Z (lower-cased) or characters beyond ASCII; a language keeps those of
    at least ``least`` of its documents. With p a source's share of a term in UNIT parts and q another's,
    f = floor((p - q)^2 / q): part ``pair`` has f summed over all kept terms, part ``term`` the ``ranks``
    terms of the largest f against the whole language.

    Null languages, sources and texts count as ''; documents without terms still make their source
    known; repeated rows count as often as they come; an empty table gives no rows; other columns are left
    out, whatever their names. Ties go to the item that is smaller in UTF-8. A task counts ``TEXT_BYTES`` of
    text (or one longer text) at a time; a language's sources (not its terms) and their pairs, which are the
    result, have to fit into a task.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    groups = table(docs.select(*named).distinct(), "groups")
    terms = kept_terms(docs, lang_col, source_col, text_col, least)
    counts = terms.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("n"))
    heads = groups.join(counts, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("head"))
    heads = heads.groupBy("lang").agg(F.sort_array(F.collect_list("head")).alias("heads"), F.sum("head.n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    # a language's sources go to several places, so that its terms needn't come to one; each has terms enough for the pairs it sums
    salts = max(1, -(-(terms.agg(F.sum(F.size("n"))).first()[0] or 0) // WALK))
    spread = heads.join(sizes, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = terms.select("lang", "terms", "at", "code", "n", "sources", F.pmod(F.xxhash64(F.get("terms", F.lit(0))), F.lit(salts)).cast("int").alias("salt"))
    blocks = dealt.join(spread, ["lang", "salt"]).select("lang", "terms", "at", "code", "n", "sources", "heads", "total", "v")
    walked = table(blocks.mapInArrow(lambda b: _walk(b, ranks), "lang string, source string, part string, item binary, value long"), "walked")
    walked = walked.withColumn("item", F.col("item").cast("string"))
    # every pair of sources of a language is in the result, also where no term was kept
    zero = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = walked.where("part = 'pair'").unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = walked.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(found).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all languages of documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, sum(n)::HUGEINT AS n FROM g GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c)::HUGEINT + 1) // (any_value(l.n) + any_value(v.v)) AS q
  FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
