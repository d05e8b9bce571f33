"""URL filters: rules first, empirical-Bayes host reputation for the rest.

A rule is a host with a path prefix; it fits its host and all subdomains where the url's path
starts with the prefix, and the longest fitting rule decides. Every other url is judged by its
host's reputation: bad outcomes of labelled pages are counted per host (before any shuffle), and
a host's rate is shrunk to its registered domain's, that to its suffix's, that to the rate of
all. The strengths of the two lower priors are beta-binomial, fitted by moments over all hosts and
domains. A host is blocked when the lower posterior bound of its bad rate exceeds ``LIMIT``. A host
without labelled pages has its domain's rate, else its suffix's, else that of all, with the spread of
every level it was backed off by.

DataFrame functions only. Pages meet reputations by an equi-join on the host whose large
side Spark may split, so a hot host does not land in one task.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged as the empty host; labels whose page is unknown do not count; where a page's labels
repeat, the worst counts; without labels nothing but rules blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: (rule, host, path, verdict)
RULES = (
    ("net/", "net", "/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"),
    ("org/fr/", "org", "/fr/", "allow"),
)
LIMIT, SIGMAS = 0.3, 1.64
#: Bounds of a fitted prior strength, and the fixed one of suffixes.
WEAKEST, STRONGEST, SUFFIX_STRENGTH = 2.0, 200.0, 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(bare, r"(?s)^([^/]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.substr(bare, F.length(host) + 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, at, prefix, says in sorted(rules, key=lambda r: len(r[0])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """The last two labels, or three under a country's second-level suffix."""
    return F.regexp_extract(host, r"((?:[^.]+\.)?(?:(?:co|com|org|net|ac|gov|edu)\.)[a-z]{2}|[^.]+\.[^.]+|[^.]*)$", 1)


def suffix_of(domain: Column) -> Column:
    return F.regexp_extract(domain, r"([^.]*)$", 1)


def _strength(units: DataFrame, mean: str) -> DataFrame:
    """One row, the prior's strength by moments over units (n, bad) around ``mean``."""
    p = F.col("bad") / F.col("n")
    m = F.col(mean)
    sums = units.agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("units"),
        F.sum(F.col("n") * (p - m) * (p - m)).alias("spread"), F.sum(F.col("n") * m * (1 - m)).alias("noise"),
    )
    base = F.col("noise") / F.col("total")
    between = (F.col("spread") - (F.col("units") - 1) * base) / (F.col("total") - F.col("squares") / F.col("total"))
    rho = F.when(F.col("total") * F.col("total") > F.col("squares"), between / F.when(base > 0, base))
    # Rounded, so that the order of summation cannot tip a verdict.
    fitted = F.when(rho > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), 1 / rho - 1))).otherwise(F.lit(STRONGEST))
    return sums.select(F.round(F.coalesce(fitted, F.lit(STRONGEST)), 6).alias("strength"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad, posterior mean, lower bound and blocked, of every host of pages.

    ``pages``: page_id, host. ``outcomes``: page_id, bad (0 or 1), one row per page.
    """
    labelled = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    every = labelled.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    every = written(every, "host-counts")  # all that follows reads one row a host
    hosts = every.where("n > 0")
    total = hosts.agg(
        ((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("overall"), (F.count(F.lit(1)) > 0).alias("any_label")
    )
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total))
    suffixes = suffixes.select("suffix", ((F.col("bad") + SUFFIX_STRENGTH * F.col("overall")) / (F.col("n") + SUFFIX_STRENGTH)).alias("suffix_mean"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    of_domains = _strength(domains, "suffix_mean").withColumnRenamed("strength", "domain_strength")
    domains = domains.crossJoin(F.broadcast(of_domains)).select(
        "domain", ((F.col("bad") + F.col("domain_strength") * F.col("suffix_mean")) / (F.col("n") + F.col("domain_strength"))).alias("domain_mean")
    )
    k = _strength(hosts.join(domains, "domain"), "domain_mean")
    every = every.join(domains, "domain", "left").join(suffixes, "suffix", "left")
    for one_row in (total, of_domains, k):
        every = every.crossJoin(F.broadcast(one_row))
    prior = F.coalesce("domain_mean", "suffix_mean", "overall")
    mean = (F.col("bad") + F.col("strength") * prior) / (F.col("n") + F.col("strength"))
    # Of a rate's spread m (1 - m), each beta prior of a strength k leaves k / (k + 1) to the level above.
    left = [F.when(known.isNull(), k / (k + 1)).otherwise(1.0) for known, k in ((F.col("domain_mean"), F.col("domain_strength")), (F.coalesce("domain_mean", "suffix_mean"), F.lit(SUFFIX_STRENGTH)))]
    spread = 1 - F.col("strength") / (F.col("strength") + 1) * left[0] * left[1]
    share = F.when(F.col("domain_mean").isNull(), spread).otherwise(1 / (F.col("n") + F.col("strength") + 1))
    low = F.col("mean") - SIGMAS * F.sqrt(F.col("mean") * (1 - F.col("mean")) * share)
    out = every.withColumn("mean", mean).withColumn("low", low)
    return out.select("host", "n", "bad", "mean", "low", (F.col("any_label") & (F.round("low", 9) > F.lit(LIMIT))).alias("blocked"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """A labelled row is a bad outcome when it is toxic or of poor quality."""
    bad = F.when((F.col("toxic") > 0) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))


def url_filters(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = split_url(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = written(reputations(cut.select("page_id", "host"), outcomes), "hosts").where("blocked").select("host", F.lit("block").alias("by_host"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    return cut.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"), outcomes_of(table(spark, sf_dir, "labels")))


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(rest, '^([^?#]*)', 1), '') AS bare FROM cut),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(bare, length(raw) + 1) AS path FROM parts),
marks AS (
  SELECT doc_id AS page_id, max(CASE WHEN toxic > 0 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM split JOIN marks USING (page_id) WHERE bad IS NOT NULL GROUP BY host),
h AS (
  SELECT *, regexp_extract(domain, '([^.]*)$', 1) AS suffix FROM (
    SELECT *, regexp_extract(host, '((?:[^.]+\.)?(?:(?:co|com|org|net|ac|gov|edu)\.)[a-z]{2}|[^.]+\.[^.]+|[^.]*)$', 1) AS domain FROM h0)),
t AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS overall, count(*) > 0 AS any_label FROM h),
s AS (SELECT suffix, (sum(bad) + 20.0::DOUBLE * any_value(overall)) / (sum(n) + 20.0::DOUBLE) AS m FROM h, t GROUP BY suffix),
d0 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM h GROUP BY domain, suffix),
d1 AS (SELECT d0.*, s.m FROM d0 JOIN s USING (suffix)),
ds AS (SELECT sum(n) AS total, sum(n * n) AS sq, count(*) AS units, sum(n * (bad / n - m) * (bad / n - m)) AS spread, sum(n * m * (1 - m)) / sum(n) AS base FROM d1),
dk AS (
  SELECT round(coalesce(CASE WHEN rho > 0 THEN least(200.0::DOUBLE, greatest(2.0::DOUBLE, 1 / rho - 1)) ELSE 200.0::DOUBLE END, 200.0), 6) AS k FROM (
    SELECT CASE WHEN total * total > sq AND base > 0 THEN (spread - (units - 1) * base) / (total - sq / total) / base END AS rho FROM ds)),
d AS (SELECT domain, (bad + k * m) / (n + k) AS dm FROM d1, dk),
h1 AS (SELECT h.host, h.n::DOUBLE AS n, h.bad::DOUBLE AS bad, d.dm AS m FROM h JOIN d USING (domain)),
hs AS (SELECT sum(n) AS total, sum(n * n) AS sq, count(*) AS units, sum(n * (bad / n - m) * (bad / n - m)) AS spread, sum(n * m * (1 - m)) / sum(n) AS base FROM h1),
hk AS (
  SELECT round(coalesce(CASE WHEN rho > 0 THEN least(200.0::DOUBLE, greatest(2.0::DOUBLE, 1 / rho - 1)) ELSE 200.0::DOUBLE END, 200.0), 6) AS k FROM (
    SELECT CASE WHEN total * total > sq AND base > 0 THEN (spread - (units - 1) * base) / (total - sq / total) / base END AS rho FROM hs)),
every AS (
  SELECT *, regexp_extract(domain, '([^.]*)$', 1) AS suffix FROM (
    SELECT DISTINCT host, regexp_extract(host, '((?:[^.]+\.)?(?:(?:co|com|org|net|ac|gov|edu)\.)[a-z]{2}|[^.]+\.[^.]+|[^.]*)$', 1) AS domain FROM split)),
prior AS (
  SELECT e.host, coalesce(h.n, 0)::DOUBLE AS n, coalesce(h.bad, 0)::DOUBLE AS bad, d.dm, coalesce(d.dm, s.m) AS known, coalesce(d.dm, s.m, overall) AS m, hk.k AS k, dk.k AS kd, any_label
  FROM every e LEFT JOIN h ON h.host = e.host LEFT JOIN d ON d.domain = e.domain LEFT JOIN s ON s.suffix = e.suffix, t, hk, dk),
post AS (
  SELECT host, any_label, (bad + k * m) / (n + k) AS mean,
    CASE WHEN dm IS NULL THEN 1 - k / (k + 1) * (kd / (kd + 1)) * (CASE WHEN known IS NULL THEN 20.0::DOUBLE / 21.0::DOUBLE ELSE 1.0::DOUBLE END) ELSE 1 / (n + k + 1) END AS share FROM prior),
blocked AS (SELECT host FROM post WHERE any_label AND round(mean - 1.64::DOUBLE * sqrt(mean * (1 - mean) * share), 9) > 0.3),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


# Labels of pages say nothing about hosts in the tables at hand, so a fixture with labels that do covers that branch.


def fixture_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter over all pages under made-up outcomes: a host's digest says how bad it is, a page's digest how
    bad it takes to be a bad one, and a quarter of the hosts have no labels."""
    pages = table(spark, sf_dir, "pages")
    own, page = F.md5(split_url(F.col("url"))[0]), F.md5(F.col("page_id").cast("string"))
    bad = (F.substring(own, 1, 1) > F.substring(page, 1, 1)).cast("int")
    known = pages.where((F.substring(own, 2, 1) >= "4") & F.col("page_id").isNotNull())
    return url_filters(pages, known.groupBy("page_id").agg(F.max(bad).alias("bad")))


_MARKS = OP9_SQL[OP9_SQL.index("marks AS (") : OP9_SQL.index("h0 AS (")]
FIXTURE_SQL = OP9_SQL.replace(
    _MARKS,
    """marks AS (SELECT page_id, max(CAST(substr(md5(host), 1, 1) > substr(md5(CAST(page_id AS VARCHAR)), 1, 1) AS INTEGER)) AS bad
  FROM split WHERE substr(md5(host), 2, 1) >= '4' AND page_id IS NOT NULL GROUP BY page_id),
""",
)
