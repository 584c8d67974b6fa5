"""Why an entity exists: factors (raw value, weight, contribution) and visits; and the details of sessions, trails and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.structure import REFIND, following, runs

#: Factors of each kind and their weights; fixed values.
SESSION = {"visits": 1.0, "searches": 0.5, "domains": 0.6, "depth": 0.7, "duration_minutes": 0.15}
TRAIL = {"visits": 1.0, "reformulations": 0.8, "depth": 0.6, "landed": 0.5}
FAMILY = {"members": 1.0, "queries": 0.7}
REOPENED = {"occurrences": 1.0, "distinct_days": 0.8}
HABIT = {"visits": 1.0, "mean_gap": 0.7, "cv": -0.6, "is_interrupted": 0.4}
FLOW = {"steps": 0.6, "occurrences": 1.0}
COMPARE = {"pages": 0.8, "domains": 0.7, "alternations": 1.0}
PAGE = dict(zip(("days", "trails", "arrivals", "typed"), REFIND, strict=True))


def _millionths(num: Column, den: Column | int) -> Column:
    """num / den to six digits, ties upwards, in whole numbers: binary fractions would settle ties either way."""
    a, b = 2_000_000 * num + den, 2 * (den if isinstance(den, Column) else F.lit(den))
    return ((a - F.pmod(a, b)) / b) / 1_000_000


def factors(rows: DataFrame, kind: str, entity: Column, weights: dict[str, float], fractions: dict[str, tuple[Column, Column | int]] | None = None) -> DataFrame:
    """kind, entity, factor, raw, weight, contribution: one row a factor of each entity, to six digits; its measures are columns of rows.

    fractions: measures that are a ratio of whole numbers, as (numerator, denominator).
    """
    cells = []
    for c, w in weights.items():
        num, den = (fractions or {}).get(c, (None, None))
        raw = F.round(F.col(c).cast("double"), 6) if num is None else _millionths(num.cast("long"), den)
        part = F.round(F.col(c).cast("double") * w, 6) if num is None else _millionths(round(w * 100) * num.cast("long"), den * 100)
        cells.append(F.struct(F.lit(c).alias("factor"), raw.alias("raw"), F.lit(w).alias("weight"), part.alias("contribution")))
    return rows.select(F.lit(kind).alias("kind"), entity.alias("entity"), F.explode(F.array(*cells)).alias("f")).select("kind", "entity", "f.*")


def session_factors(sessions: DataFrame) -> DataFrame:
    return factors(sessions, "session", F.col("session_id"), SESSION, {"duration_minutes": (F.greatest(F.col("last_ms") - F.col("first_ms"), F.lit(0)), 60_000)})


def trail_factors(trails: DataFrame) -> DataFrame:
    return factors(trails.withColumn("landed", F.col("landing_domain").isNotNull().cast("int")), "search_trail", F.col("trail_id"), TRAIL)


def refind_factors(refinds: DataFrame) -> DataFrame:
    return factors(refinds, "refind_page", F.concat_ws("::", "profile_id", "url"), PAGE)


def habit_factors(habits: DataFrame, facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("profile_id", "domain").agg(F.count("*").alias("visits"))
    rows = habits.join(counts, ["profile_id", "domain"]).withColumn("is_interrupted", F.col("interrupted").cast("int"))
    span = F.datediff("last_day", "first_day")
    return factors(rows, "habit_pattern", F.concat_ws("::", "profile_id", "domain"), HABIT, {"mean_gap": (span, F.col("days") - 1)})


def flow_factors(flows: DataFrame, steps: int) -> DataFrame:
    return factors(flows.withColumn("steps", F.lit(steps)), "path_flow", F.concat_ws("::", "profile_id", F.lit(str(steps)), "pattern"), FLOW)


def compare_factors(sets: DataFrame) -> DataFrame:
    return factors(sets, "compare_set", F.col("compare_set_id"), COMPARE)


def family_factors(families: DataFrame) -> DataFrame:
    """families: of families.family_rows."""
    return factors(families, "query_family", F.col("family_id"), FAMILY)


def reopened_factors(reopened: DataFrame) -> DataFrame:
    return factors(reopened, "reopened_investigation", F.col("investigation_id"), REOPENED)


def latest_flow(session_visits: DataFrame, pattern: list[str]) -> DataFrame:
    """The visits of the newest sequence of domains within a session that is a flow: profile_id, visit_ids, last_ms. Runs of a domain are one step, its last visit."""
    n = len(pattern)
    rows = following(runs(session_visits), n - 1)
    later = [F.get("following", F.lit(i)) for i in range(n - 1)]
    hit = F.col("domain") == pattern[0]
    for x, domain in zip(later, pattern[1:], strict=True):
        hit = hit & (x["domain"] == domain)
    ids = F.array(F.col("visit_id"), *[x["visit_id"] for x in later])
    found = rows.where(hit).select("profile_id", "visit_id", ids.alias("visit_ids"), (later[-1]["ms"] if later else F.col("ms")).alias("last_ms"))
    best = found.groupBy("profile_id").agg(F.max_by(F.struct("visit_ids", "last_ms"), F.struct("last_ms", F.negative(F.col("visit_id")))).alias("b"))
    return best.select("profile_id", "b.*")


def session_detail(session_visits: DataFrame, members: DataFrame, session_id: str) -> DataFrame:
    """A session's visits in order, each with its trail."""
    own = session_visits.where(F.col("session_id") == session_id)
    tagged = own.join(members.where(F.col("session_id") == session_id).select("visit_id", "trail_id"), "visit_id", "left")
    return tagged.select("visit_id", "raw_url", "title", "domain", "ms", "search", "engine", "trail_id", "transition").orderBy("ms", "visit_id")


def trail_detail(members: DataFrame, trail_id: str) -> DataFrame:
    return members.where(F.col("trail_id") == trail_id).select("visit_id", "ordinal", "role", "raw_url", "url", "title", "domain", "ms", "search").orderBy("ordinal")


def refind_detail(refinds: DataFrame, facts: DataFrame, members: DataFrame, trails: DataFrame, url: str, most: int = 8) -> DataFrame:
    """Of one page found again, by profile: the days of its newest visits, the newest first, and the trails they were in, the last ones first."""
    ids = refinds.where(F.col("url") == url).select("profile_id", F.explode("evidence").alias("visit_id"))
    days = ids.join(facts.where(F.col("url") == url).select("visit_id", "date_key"), "visit_id").groupBy("profile_id").agg(F.sort_array(F.collect_set("date_key"), asc=False).alias("recent_days"))
    near = ids.join(members.where(F.col("url") == url).select("visit_id", "trail_id"), "visit_id").select("profile_id", "trail_id").distinct().join(trails.select("trail_id", "last_ms"), "trail_id")
    ranked = near.groupBy("profile_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("last_ms", "trail_id")), asc=False), lambda x: x.trail_id), 1, most).alias("related_trails"))
    return days.join(ranked, "profile_id", "left")
