"""Domain canonicalisation (J4) and rule routing.

Suffix templates and rules are tables of any size: a host's ends are exploded once per distinct host and
joined to the templates by equality; rules join by host. Spark broadcasts what is small at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import lookup_host


#: A host's rows are dealt to so many tasks at most when rows are joined by host: one host may have most of them.
SPREAD = 64


def _join_by_host(df: DataFrame, table: DataFrame, host: str) -> DataFrame:
    """Left join of rows with a table of hosts that has the same column ``host``; a host's rows are spread over tasks, and
    its rows of the table go to each of them."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c in ("url", "page_id", "row_id", "host", host)]), F.lit(SPREAD))
    many = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return df.withColumn("_part", part).join(many, [host, "_part"], "left").drop("_part")


def canonical_domain(df: DataFrame, suffixes: DataFrame, url_col: str = "url",
                     key_col: str = "row_id") -> DataFrame:
    """The lookup host of each URL, replaced by the first template (by ``ord``) it
    ends with; unchanged when none matches. ``suffixes``: (ord, template). A template may end
    anywhere in a label, so every end of a host is tried."""
    hosts = df.withColumn("netloc", lookup_host(F.col(url_col)))
    ends = F.transform(F.sequence(F.lit(1), F.length("netloc")), lambda i: F.col("netloc").substr(i, F.length("netloc")))
    mapping = (hosts.select("netloc").filter(F.length("netloc") > 0).distinct()
               .select("netloc", F.explode(ends).alias("template"))
               .join(suffixes.select("ord", "template"), "template")
               .groupBy("netloc").agg(F.min_by("template", "ord").alias("_t")))
    return (_join_by_host(hosts, mapping, "netloc")
            .withColumn("canonical", F.coalesce(F.col("_t"), F.col("netloc")))
            .drop("_t"))


def route_rules(df: DataFrame, rules: DataFrame, host_col: str = "canonical") -> DataFrame:
    """J5 + F6: left join the per-host rule row; ``has_rule`` is false when the host has
    no rule (no rule extraction, the generic path applies)."""
    r = rules.withColumnRenamed("netloc", host_col).withColumn("_found", F.lit(True))
    out = _join_by_host(df, r, host_col)
    return out.withColumn("has_rule", F.coalesce("_found", F.lit(False))).drop("_found")
