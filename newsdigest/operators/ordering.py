"""Order-dependent operators: exact global row numbers, domain interleave (W1),
domain counts (A7) and near-equal batches (W2).

"First wins" and stable sorts of the monitored job depend on row order, so every
row carries a ``pos``. Global numbering never goes through one partition: the data is
range-sorted, each partition is counted (one row per partition), and the small
offset table is broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_to_parquet


def global_row_number(df: DataFrame, order_by: list, name: str = "rn", drop: tuple = ()) -> DataFrame:
    """Add a 1-based row number in ``order_by`` order (ties broken by the given
    columns only, so pass a total order). Columns in ``drop`` are only sorted by: they
    are not written. Scales: one range sort, one count per
    partition, one broadcast of ``#partitions`` offsets."""
    tagged = (df.orderBy(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()).drop(*drop))
    tagged = cut_to_parquet(tagged, "numbered")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table, numbered with a tiny window
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = (tagged.join(F.broadcast(offsets), "_pid")
           .withColumn(name, F.coalesce(F.col("_off"), F.lit(0))
                       + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)) + 1)
           .drop("_pid", "_mid", "_off"))
    return out


def rank_within_group(df: DataFrame, group_col: str, order_cols: list, name: str = "rank") -> DataFrame:
    """1-based rank of each row inside its group in ``order_cols`` order (a total order
    inside the group), without a window partitioned by the group: a range sort on
    (group, order) splits a group that holds a third of all rows over many partitions;
    each partition is counted per group (one small row per partition and group), and
    the offsets of earlier partitions of the same group are joined back."""
    tagged = (df.orderBy(F.col(group_col), *order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_to_parquet(tagged, "ranked")
    # one row per (partition, group): bounded by #partitions + #groups
    pieces = tagged.groupBy("_pid", group_col).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_pid", group_col, "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    offsets = offsets.withColumnsRenamed({"_pid": "_opid", group_col: "_ogroup"})
    same = (F.col("_pid") == F.col("_opid")) & F.col(group_col).eqNullSafe(F.col("_ogroup"))  # null is a group too
    return (tagged.join(offsets, same)
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1)
            .drop("_pid", "_mid", "_m0", "_off", "_opid", "_ogroup"))


def netloc_of(url) -> Column:
    from ..functions.urls import netloc
    return netloc(url)


def domain_counts(items: DataFrame, url_col: str = "url", pos_col: str = "pos") -> DataFrame:
    """Per host, number of items and first position; largest first, ties by
    first appearance."""
    return (items.withColumn("netloc", netloc_of(F.col(url_col)))
            .groupBy("netloc")
            .agg(F.count(F.lit(1)).alias("n_items"), F.min(pos_col).alias("first_pos")))


def interleave_domains(items: DataFrame, url_col: str = "url", pos_col: str = "pos",
                       out_col: str = "order_key") -> DataFrame:
    """Round-robin over hosts. Hosts are ranked by item count (desc), ties by first
    appearance; round ``r`` takes the ``r``-th item of every host that still has one.

    The rank inside a host comes from :func:`rank_within_group`: a host holding
    a third of all rows is split over many partitions. The host
    counts are a partial aggregate, one row per host, joined back. The output key is
    ``(round, -count, first position)``."""
    with_host = items.withColumn("netloc", netloc_of(F.col(url_col)))
    hosts = (with_host.groupBy("netloc")
             .agg(F.count(F.lit(1)).alias("_cnt"), F.min(pos_col).alias("_first")))
    ranked = rank_within_group(with_host, "netloc", [F.col(pos_col)], "round")
    # hosts in visiting order (count desc, first appearance); one row per host
    hosts = global_row_number(hosts, [F.col("_cnt").desc(), F.col("_first")], "_hrank")
    out = ranked.join(hosts, "netloc")
    # (round, host rank) packed in one long: fixed-width, so aggregates over it hash
    key = F.col("round").cast("long") * F.lit(1 << 31) + F.col("_hrank")
    return (out.withColumn("host_order", F.struct(F.col("round"), (-F.col("_cnt")).alias("c"),
                                                  F.col("_first").alias("f")))
            .withColumn(out_col, key)
            .drop("_cnt", "_first", "_hrank"))



def interleave_sort_cols() -> list:
    return [F.col("round"), F.col("host_order.c"), F.col("host_order.f")]


def batch_assign(items: DataFrame, batch_size: int, order_col: str = "pos",
                 out_col: str = "batch") -> DataFrame:
    """``ceil(n / batch_size)`` near-equal batches in ``order_col`` order; the first
    ``n % k`` batches get one extra row (``array_split`` sizes, ``ntile`` semantics)."""
    numbered = global_row_number(items, [F.col(order_col)], "_rn")
    n = numbered.count()  # one scalar to the driver; the numbered rows stay distributed
    k = max(1, -(-n // batch_size))
    q, rem = divmod(n, k)
    big = q + 1
    r = F.col("_rn") - 1
    bucket = F.when(r < F.lit(big * rem), F.floor(r / F.lit(big)))
    if q > 0:
        bucket = bucket.otherwise(F.lit(rem) + F.floor((r - F.lit(big * rem)) / F.lit(q)))
    return numbered.withColumn(out_col, (bucket + 1).cast("int")).drop("_rn")
