"""URL filter by empirical-Bayes host reputation, under fixed rules.

Labelled page outcomes are counted per host, registered domain and suffix. Bad rates shrink
from the whole table to suffix, domain and host through beta-binomial priors: each level's
prior has its parent's posterior mean, and a strength fitted to how much the level's rates
differ from their parents' beyond binomial noise. A host is blocked when the lower bound of its
posterior bad rate is above ``MAX_BAD``; a rule that fits the url comes first.

Defined results: a null url or one without ``://`` has an empty host and path and is judged like
any host; a page without label only carries no outcome; of several labels of a page, one bad
label makes it bad; null outcomes are ignored; repeated rows are judged alike and counted as
rows; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Fixed values: (rule, verdict). A rule is a host and the start of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A host is blocked when its bad rate is surely above this: its posterior mean less ``SURE``
#: standard deviations.
MAX_BAD, SURE = 0.5, 1.645
#: Bounds of the fitted correlation of outcomes within a group. Prior strength is (1 - r) / r, so a
#: prior counts as two pages at least, and a single label does not block a host.
LEAST_R, MOST_R = 1e-4, 0.3333

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_host_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    # only what stands before :// may be skipped, so the first :// counts
    return (pages.withColumn("host", F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract(url, _URL, 2)))


def rule_of(rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest rule that fits (value 0) or its verdict (value 1); null if none fits. Rules
    are configuration, written by hand; they become one expression and no join."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = rule[0].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def _levels(hosts: DataFrame) -> DataFrame:
    """Registered domain: the last two labels of a host; suffix: the last one."""
    return (hosts.withColumn("domain", F.substring_index("host", ".", -2))
            .withColumn("suffix", F.substring_index("host", ".", -1)))


def _shrink(groups: DataFrame, mean: str) -> DataFrame:
    """groups (n, k and their parent's posterior ``mean``) with a and b of their posterior. The
    strength is fitted by moments: n (k/n - m)^2 / (m (1 - m)) is 1 + (n - 1) r on average."""
    m = F.col(mean)
    z = F.when(F.col("n") > 0, F.pow(F.col("k") - F.col("n") * m, F.lit(2.0)) / (F.col("n") * m * (1 - m)))
    fit = groups.agg(F.sum(z).alias("z"), F.count(F.when(F.col("n") > 0, 1)).alias("g"),
                     F.sum(F.when(F.col("n") > 0, F.col("n") - 1)).alias("more")).first()
    r = min(MOST_R, max(LEAST_R, (fit.z - fit.g) / fit.more if fit.more else LEAST_R))
    strength = (1 - r) / r
    return (groups.withColumn("a", F.lit(strength) * m + F.col("k"))
            .withColumn("b", F.lit(strength) * (1 - m) + F.col("n") - F.col("k")))


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes (host, bad 0/1/null; one row per page) to one row per host: host, labelled,
    labelled_bad, bad_mean, bad_bound. Only the counts of three levels and one row of sums each
    are needed; a host of a third of all pages is combined map-side."""
    hosts = cut(_levels(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))), "hosts")
    up = lambda d, *by: d.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = lambda name: (F.col("a") / (F.col("a") + F.col("b"))).alias(name)
    base = ((total.k or 0) + 0.5) / ((total.n or 0) + 1)
    suffixes = _shrink(suffixes.withColumn("m", F.lit(base)), "m").select("suffix", mean("suffix_mean"))
    domains = _shrink(domains.join(suffixes, "suffix"), "suffix_mean").select("domain", mean("domain_mean"))
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return _shrink(hosts.join(domains, "domain"), "domain_mean").select(
        "host", F.col("n").alias("labelled"), F.col("k").alias("labelled_bad"), mean("bad_mean"), (a / (a + b) - SURE * sd).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """pages (page_id, url), outcomes (page_id, bad) to page_id, host, path, rule, verdict,
    labelled, labelled_bad of every page."""
    found = with_host_path(pages.select("page_id", "url")).drop("url")
    bad = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = reputation(found.select("page_id", "host").join(bad, "page_id", "left"))
    by_host = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return (found.join(hosts, "host")
            .select("page_id", "host", "path", rule_of(rules, 0).alias("rule"),
                    F.coalesce(rule_of(rules, 1), by_host).alias("verdict"), "labelled", "labelled_bad"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of its id: quality 0 is bad."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)


_POSTERIOR = """
{name}_fit AS (
  SELECT least(0.3333::DOUBLE, greatest(0.0001::DOUBLE, CASE WHEN sum(CASE WHEN n > 0 THEN n - 1 END) > 0
           THEN (sum(CASE WHEN n > 0 THEN (k - n * m) * (k - n * m) / (n * m * (1 - m)) END) - count(CASE WHEN n > 0 THEN 1 END))
                / sum(CASE WHEN n > 0 THEN n - 1 END) ELSE 0.0001 END)) AS r FROM {name}),
{name}_post AS (
  SELECT {name}.*, (1 - r) / r * m + k AS a, (1 - r) / r * (1 - m) + n - k AS b FROM {name}, {name}_fit)"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
l AS (SELECT doc_id, max(1 - quality) AS bad FROM labels GROUP BY doc_id),
c AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) FROM c) AS m FROM c GROUP BY suffix),
""" + _POSTERIOR.format(name="s") + """,
d AS (
  SELECT x.domain, x.n, x.k, a / (a + b) AS m
  FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM c GROUP BY domain, suffix) x JOIN s_post USING (suffix)),
""" + _POSTERIOR.format(name="d") + """,
h AS (SELECT c.host, c.n, c.k, a / (a + b) AS m FROM c JOIN d_post USING (domain)),
""" + _POSTERIOR.format(name="h") + """,
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS labelled, k::BIGINT AS labelled_bad
FROM p JOIN h_post USING (host) LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""
