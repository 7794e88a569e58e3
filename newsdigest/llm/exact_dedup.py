"""Exact dedup over a persistent digest index.

The index is a Parquet table with one row per known text digest, bucketed and sorted by the
digest. A batch is digested (text never shuffles), reduced to one row per digest with a
map-side combine, and joined to the index by sort-merge: the index side is read bucket by
bucket without an exchange. Digests the index lacks (anti-join) are appended.

Defined results: null text counts as empty text; equal texts are texts that are identical after
each run of white space becomes one space; of equal texts in a batch the smallest ``doc_id``
stays, unless an earlier batch already holds the text; rows that repeat a ``doc_id`` and its
text are reported once per row, with the same decision. An empty batch gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, shared_path

#: Buckets of a new index. At 100 TB choose thousands: one bucket should fit a task.
BUCKETS = 48
#: Batches by id in which the query loads its table into a new index.
BATCHES = 2


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "), 256)


class DigestIndex:
    """One row per known digest: ``text_sha256``, ``keep_id``. ``path`` outlives the session;
    opening it again registers the same buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Each task holds whole buckets, so a batch adds one file per bucket."""
        (rows.select("text_sha256", "keep_id")
         .repartition(self.buckets, "text_sha256")
         .write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide every row of ``docs`` and add its new digests to the index.

        Returns doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256.
        """
        return _decisions(*self._load(docs, id_col, text_col))

    def dedup_in_ranges(self, docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Like :meth:`dedup`, but ``docs`` comes as that many batches by ranges of the id, smallest ids first and rows
        without an id last, so that each batch meets what the earlier ones left in the index. ``group_size`` counts the
        rows of all batches. Ranges end at approximate quantiles; equal ids are in one batch."""
        at = [i / batches for i in range(1, batches)]
        ends = docs.agg(F.percentile_approx(id_col, at, 10_000)).first()[0] or []
        ends = sorted(set(ends))
        key = F.col(id_col)
        ranges = [F.lit(True) if not ends else key < ends[0]]
        ranges += [(key >= a) & (key < b) for a, b in zip(ends, ends[1:], strict=False)]
        if ends:
            ranges.append((key >= ends[-1]) | key.isNull())
        loads = [self._load(docs.filter(r), id_col, text_col) for r in ranges]
        digests, decided = (functools.reduce(DataFrame.unionByName, side) for side in zip(*loads, strict=True))
        decided = decided.groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        return _decisions(digests, cut(decided, "decided"))

    def _load(self, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        """Adds a batch to the index; its rows' digests, and each digest's keep_id and rows in the batch."""
        digests = cut(docs.select(F.col(id_col).alias("doc_id"),
                                  text_digest(F.col(text_col)).alias("text_sha256")), "digests")
        groups = digests.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"),
                                                    F.count(F.lit(1)).alias("group_size"))
        # the anti-join must not see what this batch appends: written before the append
        fresh = cut(groups.join(self.read().hint("merge"), "text_sha256", "left_anti")
                    .withColumnRenamed("first_id", "keep_id"), "fresh")
        self.append(fresh)
        # one narrow row per digest, cut so that both sides of the last join are exchanged and a
        # hot digest can be split at run time
        decided = cut(groups.join(self.read().hint("merge"), "text_sha256")
                      .select("text_sha256", "keep_id", "group_size"), "decided")
        return digests, decided


def _decisions(digests: DataFrame, decided: DataFrame) -> DataFrame:
    return (digests.join(decided, "text_sha256")
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    index = DigestIndex(spark, shared_path(spark, "digest-index"))
    return index.dedup_in_ranges(table(spark, sf_dir, "documents").select("doc_id", "text"), BATCHES)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
