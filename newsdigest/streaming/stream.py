"""Structured Streaming versions of the day-scoped state (ST1-ST4).

The monitored job re-runs through the day and keeps state per calendar day. As a
stream: a file source of captured items, and ``foreachBatch`` bodies that keep their state in
day-partitioned tables (dynamic partition overwrite, so a replayed batch
rewrites the same partitions: at-least-once delivery gives exactly-once state). No watermark
stands between an event and its day: files may come in any order of days, and every event counts.

Sinks and checkpoints live under the session's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..session import cut_lineage, ensure_checkpoint_dir


def stream_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:8]}"


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                 max_files: int = 1) -> DataFrame:
    """A file stream over one table of the folder (schema taken from the batch table)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", max_files)
            .parquet(sf_dir))


def with_event_time(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """``events.ts`` is TIMESTAMP_NTZ (wall clock); watermarks need TIMESTAMP. The wall
    clock is read as UTC explicitly, so event times, 1-day windows and days do not
    depend on the session time zone."""
    return (df.withColumn("event_time", F.concat(F.col(ts_col).cast("string"), F.lit("Z")).cast("timestamp"))
            .withColumn("day", F.to_date(F.col(ts_col))))


def run_available(query_builder, out: str, fmt: str = "parquet"):
    """Start a query with the availableNow trigger and wait for it to finish."""
    q = query_builder.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


#: The partitions of a batch sink: the day, and the micro-batch that wrote the rows.
DAY, BATCH = "run_date", "batch"


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows that :func:`write_batch` has put under ``path`` so far (``schema`` without the partition columns); None
    if there are none yet. A sink that exists and cannot be read is an error."""
    try:
        return spark.read.schema(f"{schema}, {DAY} date, {BATCH} long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch's rows in partitions of their day and of the batch. A replayed batch rewrites its own
    partitions and no other, so nothing is counted twice."""
    (rows.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DAY, BATCH).parquet(path))


def seen_keys(path: str, key_col: str):
    """ST1: a ``foreachBatch`` body that stores the first sighting of every (day, key): keys that no earlier batch has in
    their day's partitions. Days may come in any order, since the state of a day is its partitions and not an operator's
    memory; a batch reads only the days that it touches."""
    def first(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(F.col("day").alias(DAY), key_col).distinct().persist()
        kind = batch.schema[key_col].dataType.simpleString()
        earlier = read_batches(batch.sparkSession, path, f"{key_col} {kind}")
        fresh = batch
        if earlier is not None:
            days = F.broadcast(batch.select(DAY).distinct())  # calendar days of one batch
            fresh = batch.join(earlier.filter(F.col(BATCH) < batch_id).join(days, DAY, "left_semi"), [DAY, key_col], "left_anti")
        write_batch(fresh, batch_id, path)
        batch.unpersist()
    return first


def late_drop(stream: DataFrame, run_day, watermark: str = "1 day") -> DataFrame:
    """ST3: rows whose day is not the run day are discarded (watermark for the late
    bound, explicit day filter for the run-day rule)."""
    return stream.withWatermark("event_time", watermark).filter(F.col("day") == F.lit(run_day))


def daily_counts(path: str, group_col: str):
    """ST4: a ``foreachBatch`` body that stores, per day and group, the number of events of each batch. Late days
    are counts like any other; :func:`total_counts` adds them up."""
    def count(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.groupBy(F.col("day").alias(DAY), group_col).agg(F.count(F.lit(1)).alias("n_events")), batch_id, path)
    return count


def total_counts(spark: SparkSession, path: str, group_col: str, kind: str = "string") -> DataFrame | None:
    """(run_date, group, n_events) over all batches so far."""
    parts = read_batches(spark, path, f"{group_col} {kind}, n_events long")
    return None if parts is None else parts.groupBy(DAY, group_col).agg(F.sum("n_events").alias("n_events"))


def upsert_batches(state_path: str, keys, run_col: str, pos_col: str):
    """ST2: ``foreachBatch`` body: merge the batch into the day partitions it touches
    (read those partitions, last write wins per key, overwrite them)."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("batch_id", F.lit(batch_id))
        batch = batch.persist()  # read twice: for its days and its rows
        try:
            # with a schema, nothing is read here: only a missing path means that there is no state yet,
            # and a state that cannot be read fails the batch
            current = spark.read.schema(batch.schema).parquet(state_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            current = None
        keys_all = ["run_date", *keys]
        merged = batch if current is None else current.join(
            batch.select("run_date").distinct(), "run_date", "left_semi").unionByName(batch)
        cols = [c for c in merged.columns if c not in keys_all]
        order = F.struct(F.col(run_col), F.col(pos_col))
        out = (merged.groupBy(*keys_all).agg(F.max_by(F.struct(*cols), order).alias("_l"))
               .select(*keys_all, *[F.col(f"_l.{c}").alias(c) for c in cols]))
        # cut the lineage from the partitions being rewritten (reliable checkpoint)
        S.write_day(cut_lineage(out), state_path)
        batch.unpersist()
    return merge
