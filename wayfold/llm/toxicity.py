"""Toxicity: lexicon hits (misspelled ones too) in context windows, weighed by a small trained model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import lexicon
from wayfold.llm.store import table
from wayfold.llm.tokens import slices

#: Most labelled rows that the model is fitted on (those of the smallest hash of their id).
SAMPLE = 20_000
#: A term is in at least LEAST toxic texts, LIFT times likelier in them than in others, with a
#: likelihood ratio statistic (chi-squared, one degree) that chance exceeds once in 10,000 words.
LEAST, LIFT, EVIDENCE = 3, 8.0, 15.1
#: Tokens on either side of a hit that its context holds; bytes of quotation marks.
WINDOW = 25
QUOTES = (b'"', "“".encode(), "”".encode(), "„".encode(), "«".encode(), "»".encode())
#: Times a spelling that isn't a term may be in texts that aren't toxic before it counts as a word of its own.
CLEAN_USES = 1
FEATURES = 10


@dataclass
class Model:
    """terms, spellings near a term that are words of their own, log-odds of terms, feature means and scales, weights (bias last)."""

    automaton: lexicon.Lexicon
    plain: frozenset[bytes]
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hits(texts: pa.Array, automaton: lexicon.Automaton | lexicon.Lexicon):
    """Per slice: first row, rows, and of each hit its row, token index in the row, term * 4 + edits, spelling and whether it is quoted."""
    for first, data, off in slices(pc.utf8_lower(texts)):
        rows = len(off) - 1
        start, end, row = lexicon.token_bounds(data, off)
        got = automaton.match(data, start, end)
        at = np.flatnonzero(got >= 0)
        count = np.bincount(row, minlength=rows)
        base = np.concatenate([[0], np.cumsum(count)])
        quoted = np.zeros(len(at), bool)
        for i, t in enumerate(at):
            lo, hi = max(t - WINDOW, base[row[t]]), min(t + WINDOW, base[row[t] + 1] - 1)
            # a text's marks before its first and after its last token count too
            left = off[row[t]] if lo == base[row[t]] else start[lo]
            right = off[row[t] + 1] if hi == base[row[t] + 1] - 1 else end[hi]
            before, after = data[left : start[t]].tobytes(), data[end[t] : right].tobytes()
            quoted[i] = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        spelled = [bytes(data[start[t] : end[t]]).lower() for t in at]
        yield first, count, row[at], at - base[row[at]], got[at], spelled, quoted


def features(texts: pa.Array, automaton: lexicon.Automaton | lexicon.Lexicon, plain: frozenset[bytes], odds: np.ndarray | None = None) -> np.ndarray:
    """One row a text: exact, misspelled and quoted hits (logs), most hits in a window, hits a token, any hit, log length,
    then log-odds of distinct terms, quoted ones apart: sums (logs) of exact and misspelled ones, and the greatest."""
    out = np.zeros((len(texts), FEATURES))
    for first, count, row, place, got, spelled, quoted in _hits(texts, automaton):
        keep = np.array([g % 4 == 0 or s not in plain for g, s in zip(got, spelled, strict=True)], bool) if len(row) else np.zeros(0, bool)
        row, place, term, edits, quoted = row[keep], place[keep], got[keep] // 4, got[keep] % 4, quoted[keep]
        n = len(count)
        own = lambda m: np.bincount(row[m], minlength=n)  # noqa: E731, B023
        exact, near, said = own((edits == 0) & ~quoted), own((edits > 0) & ~quoted), own(quoted)
        most = np.zeros(n)
        key = row * (1 << 32) + place
        np.maximum.at(most, row, np.searchsorted(key, key + WINDOW, "right") - np.arange(len(key)))
        worth = np.ones(len(term)) if odds is None else odds[term]

        def total(m, row=row, term=term, worth=worth, n=n):
            once = np.flatnonzero(m)[np.unique((row * (1 << 32) + term)[m], return_index=True)[1]]
            return np.bincount(row[once], worth[once], minlength=n)

        peak = np.zeros(n)
        np.maximum.at(peak, row[~quoted], (worth / (1 + edits))[~quoted])
        out[first : first + n] = np.stack(
            [np.log1p(exact), np.log1p(near), np.log1p(said), np.log1p(most), 100 * (exact + near) / np.maximum(count, 20), exact + near > 0, np.log1p(count)]
            + [np.log1p(total((edits == 0) & ~quoted)), np.log1p(total((edits > 0) & ~quoted)), peak],
            axis=1,
        )
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features: means, scales, weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, pull = np.zeros(a.shape[1]), ridge * np.append(np.ones(a.shape[1] - 1), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull) + 1e-9 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def held_out(doc_id: Column) -> Column:
    """Rows that the contract keeps from learning; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn terms and weights from labelled rows that aren't held out.

    At most SAMPLE labelled ids are drawn, by hash, before any text is read; that list is of
    bounded size, so it is broadcast and texts aren't shuffled. Copies of a text count once.
    Without labels of both kinds the model has no terms and scores every text alike.
    """
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    drawn = label.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "_id")
    rows = table(own.groupBy(F.md5("text").alias("h")).agg(F.max("text").alias("text"), F.max("y").alias("y")), "toxic-train")
    size = rows.agg(F.count("*"), F.sum("y")).first()
    total, toxic = size[0], size[1] or 0
    words = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    bad, good, all_bad, all_good = F.col("bad"), F.col("n") - F.col("bad"), max(toxic, 1), max(total - toxic, 1)
    lift = (bad / all_bad) / ((good + 0.5) / all_good)
    share = (all_bad + all_good) / F.col("n")
    chance = 2 * (bad * F.log(bad * share / all_bad) + F.when(good > 0, good * F.log(good * share / all_good)).otherwise(0.0))
    # log-odds less 1.645 standard errors: a term of little evidence weighs little
    odds = F.greatest(F.log(lift) - 1.645 * F.sqrt(1 / bad + 1 / (good + 0.5)), F.lit(0.0))
    found = counts.where((bad >= LEAST) & (F.length("word") >= 3)).where((lift >= LIFT) & (chance >= EVIDENCE)).select("word", odds.alias("odds")).orderBy("word")
    # bounded by the sample: LEAST uses each in at most SAMPLE texts, fewer by the evidence
    learned = found.collect() if 0 < toxic < total else []
    terms, worth = [r.word for r in learned], np.array([r.odds for r in learned])
    automaton = lexicon.build_parts(terms, anchored=False)

    def uses(batches):
        for batch in batches:
            for first, _, row, _, got, spelled, _ in _hits(batch.column(0), automaton):
                y = batch.column(1).to_numpy(zero_copy_only=False)
                pick = [(s, int(y[first + r])) for r, g, s in zip(row, got, spelled, strict=True) if g % 4]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in pick], pa.binary()), pa.array([v for _, v in pick], pa.int32())], ["s", "y"])

    clean = F.sum(1 - F.col("y"))
    near = rows.select("text", "y").mapInArrow(uses, "s binary, y int").groupBy("s").agg(clean.alias("clean")).where(F.col("clean") > CLEAN_USES)
    plain = frozenset(bytes(r.s) for r in near.collect()) if terms else frozenset()

    def measure(batches):
        for batch in batches:
            x = features(batch.column(0), automaton, plain, worth)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    data = rows.select("text", "y").mapInArrow(measure, "x array<double>, y int").toPandas() if total else None
    if data is None or not len(data):
        return Model(automaton, plain, worth, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    x, y = np.array(data["x"].tolist()), data["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same sums, whatever order rows come in
    x, y = x[order], y[order]
    return Model(automaton, plain, worth, *fit(x, y))


def toxic_score(model: Model):
    """A Column function: the model's score of a text, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts, model.automaton, model.plain, model.odds)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add held_out, score and predicted to docs (replacing columns of these names), one row per row.

    Texts are scored where they are, without a shuffle; nulls and empty texts get the score of a
    text without hits. An empty table gives no rows; repeated rows are scored alike.
    """
    model = train(docs, labels, id_col, text_col)
    scored = docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", toxic_score(model)(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    score = toxic_score(model)(F.coalesce(F.col("text"), F.lit("")))
    return docs.where(score < 0.5)
