"""URL filters: rules first, then the host's reputation under nested beta-binomial priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.store import table
from wayfold.llm.text import ascii_lower

#: Suffixes of more than one label, fixed values; a registered domain has one label more.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "co.za")
#: A host is blocked when its share of good pages lies below LIMIT with this many standard deviations to spare.
LIMIT, DEVIATIONS = 0.5, 1.6448536269514722
#: Prior strength in pages where a level has too little data to estimate one, and its bounds.
STRENGTH, WEAKEST, STRONGEST = 10.0, 1.0, 1000.0
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; ports and users don't count, addresses are domains of their own."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$|\.+$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    n = F.when(last(2).isin(*LONG_SUFFIXES), 2).otherwise(1)
    address = bare.rlike(r"^[\d.]+$") | F.startswith(bare, F.lit("["))
    domain = F.when(address, bare).when(n == 2, last(3)).otherwise(last(2))
    return domain, F.when(address, F.lit("")).when(n == 2, last(2)).otherwise(last(1))


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts: host, domain, suffix, n (labelled pages), k (good ones). Adds mean and deviation of each host's good share.

    Level by level, the mean of the level above is shrunk towards the level's own outcomes: with
    prior Beta(s * m, s * (1 - m)) the mean becomes (s * m + k) / (s + n). The strength s of a level
    is estimated from all its groups by moments: their weighted squared distance from the level
    above exceeds binomial noise by the spread between them.
    """
    top = hosts.agg(F.sum("n").alias("n0"), F.sum("k").alias("k0")).select(((F.coalesce("k0", F.lit(0)) + 1.0) / (F.coalesce("n0", F.lit(0)) + 2.0)).alias("m0"))
    above = top
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        own = hosts.groupBy(*keys).agg(F.sum("n").alias(f"n_{level}"), F.sum("k").alias(f"k_{level}"))
        own = own.join(above, keys[:-1]) if i else own.crossJoin(F.broadcast(top))  # one line
        n, k, m = F.col(f"n_{level}").cast("double"), F.col(f"k_{level}").cast("double"), F.col(f"m{i}")
        # with N groups of n pages, sum n(p - m)^2 - sum m(1 - m) is about sum (n - 1) * spread
        share = F.when(n > 0, k / n)
        noise, gap = m * (1 - m), F.when(n > 0, n * (share - m) * (share - m))
        fit = own.agg(
            F.sum(gap).alias("gap"), F.sum(F.when(n > 0, noise)).alias("noise"), F.sum(F.when(n > 0, n - 1)).alias("free"), F.avg(F.when(n > 0, noise)).alias("each")
        )
        spread = F.when((F.col("free") > 0) & (F.col("gap") > F.col("noise")), (F.col("gap") - F.col("noise")) / F.col("free"))
        strength = F.when(F.coalesce("free", F.lit(0.0)) <= 0, STRENGTH).when(spread.isNull(), STRONGEST).otherwise(
            F.least(F.greatest(F.col("each") / spread - 1, F.lit(WEAKEST)), F.lit(STRONGEST))
        )
        fit = fit.select(strength.cast("double").alias(f"s{i + 1}"))
        own = own.crossJoin(F.broadcast(fit))  # one line
        s = F.col(f"s{i + 1}")
        above = own.withColumn(f"m{i + 1}", (s * m + k) / (s + n)).drop(f"m{i}", *[f"{x}_{LEVELS[i - 1]}" for x in "nk" if i], *[f"s{i}"] * bool(i))
    n, s, m = F.col("n_host"), F.col("s3"), F.col("m3")
    return above.select("host", m.alias("good"), F.sqrt(m * (1 - m) / (s + n + 1)).alias("deviation"), n.alias("n"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """Return id_col, host, path, rule, verdict, n_labelled, good, upper: one row per row of pages.

    outcomes: id_col and good (0 or 1, several rows of an id count each). rules: (rule, verdict), a
    rule being a host and a path in one string; it fits its host and all subdomains where the URL's
    path starts with its path, and the longest wins. Without a rule, a host is blocked when the
    upper posterior bound of its share of good pages, mean + deviations * sd, is below the limit.

    Rules and reputations meet per distinct host, after hosts are counted with map-side sums; pages
    then join their hosts, which Spark broadcasts or splits as their size asks. Null URLs and URLs
    without ``://`` have the empty host, which is judged like any other; null ids have no outcomes;
    an empty table gives no rows.
    """
    host, path = url_parts(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    labelled = outcomes.where(F.col("good").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("int")).alias("k"))
    counted = slim.select("_id", "host").join(labelled, "_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    domain, suffix = domain_parts(F.col("host"))
    known = reputations(table(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts"))
    listed = F.array(*[F.struct(F.lit(r.split("/", 1)[0]).alias("h"), F.lit("/" + r.split("/", 1)[1]).alias("p"), F.lit(r).alias("rule"), F.lit(v).alias("v")) for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0]))])
    fits = F.filter(listed, lambda r: (F.col("host") == r.h) | F.endswith(F.col("host"), F.concat(F.lit("."), r.h)))
    known = known.withColumn("rules", fits).withColumn("upper", F.col("good") + deviations * F.col("deviation"))
    out = slim.join(known, "host").withColumn("won", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r.p)), F.lit(0)))
    verdict = F.coalesce(F.col("won.v"), F.when(F.col("upper") < limit, "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), verdict.alias("verdict"), F.col("n").cast("long").alias("n_labelled"), "good", "upper")


#: The rules that the contract of op1 fixes.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page; a page is good if its label has quality and isn't toxic."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    out = url_filter(pages.select("page_id", "url"), outcomes, RULES)
    return out.withColumns({c: F.round(c, 6) for c in ("good", "upper")})


def _sql() -> str:
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    cases = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, p in (r.split("/", 1) for r, _ in sorted(RULES, key=lambda x: (-len(x[0]), x[0])))
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    sql = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 1 AND toxic = 0)::INT) AS k FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
c AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$|\.+$', '') AS bare FROM c),
l AS (SELECT *, string_split(bare, '.') AS ls, regexp_matches(bare, '^[\d.]+$') OR starts_with(bare, '[') AS address FROM b),
e AS (SELECT *, array_to_string(ls[-1:], '.') AS l1, array_to_string(ls[-2:], '.') AS l2, array_to_string(ls[-3:], '.') AS l3 FROM l),
h AS (SELECT host, n, k, CASE WHEN address THEN bare WHEN l2 IN ({long}) THEN l3 ELSE l2 END AS domain,
  CASE WHEN address THEN '' WHEN l2 IN ({long}) THEN l2 ELSE l1 END AS suffix FROM e),
top AS (SELECT (coalesce(sum(k), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS m FROM h),
g1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h, top GROUP BY suffix),
{{f1}}, r1 AS (SELECT suffix, (s * m + k) / (s + n) AS m FROM g1, f1),
g2 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN r1 USING (suffix) GROUP BY suffix, domain),
{{f2}}, r2 AS (SELECT suffix, domain, (s * m + k) / (s + n) AS m FROM g2, f2),
g3 AS (SELECT host, h.n, h.k, m FROM h JOIN r2 USING (suffix, domain)),
{{f3}}, r3 AS (SELECT host, n, s, (s * m + k) / (s + n) AS m FROM g3, f3),
v AS (SELECT page_id, host, path, CASE {cases} END AS rule, n::BIGINT AS n_labelled, m AS good, m + {DEVIATIONS!r}::DOUBLE * sqrt(m * (1 - m) / (s + n + 1)) AS upper FROM p JOIN r3 USING (host))
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, CASE WHEN upper < {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  n_labelled, round(good, 6) AS good, round(upper, 6) AS upper FROM v
"""
    for i in (1, 2, 3):
        fit = f"""a{i} AS (SELECT sum(n * (k / n - m) * (k / n - m)) AS gap, sum(m * (1 - m)) AS noise, sum(n - 1) AS free, avg(m * (1 - m)) AS each FROM g{i} WHERE n > 0),
f{i} AS (SELECT CASE WHEN coalesce(free, 0) <= 0 THEN {STRENGTH}::DOUBLE WHEN gap > noise THEN least(greatest(each / ((gap - noise) / free) - 1, {WEAKEST}::DOUBLE), {STRONGEST}::DOUBLE) ELSE {STRONGEST}::DOUBLE END AS s FROM a{i})"""
        sql = sql.replace(f"{{f{i}}}", fit)
    return sql


OP1_SQL = _sql()
