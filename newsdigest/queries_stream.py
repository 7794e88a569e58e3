"""Streaming queries (ST1-ST4): each runs a stream over ``events`` to completion
(availableNow trigger) into a sink under the shared checkpoint folder and returns the
sink read back as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import latin_config
from .streaming import stream as ST

CFG = latin_config()


def _url(c="user_id"):
    return F.concat(F.lit("https://u"), F.col(c).cast("string"), F.lit(".example.org/"))


def _events(spark, sf):
    return ST.with_event_time(ST.event_stream(spark, sf)).withColumn("url", _url())


def q_stream_seen_keys(spark, sf):
    out = ST.stream_dir(spark, "seen_keys")
    ST.run_available(_events(spark, sf).writeStream.foreachBatch(ST.seen_keys(f"{out}/data", "url"))
                     .option("checkpointLocation", f"{out}/_chk"), out)
    return spark.read.parquet(f"{out}/data").select(F.col("run_date").alias("day"), "url")


SQL_SEEN = """SELECT DISTINCT CAST(ts AS DATE) AS day, 'https://u' || CAST(user_id AS VARCHAR) || '.example.org/' AS url
FROM events"""


def q_stream_state_upsert(spark, sf):
    out = ST.stream_dir(spark, "state")
    items = _events(spark, sf).select(
        F.col("day").alias("run_date"), F.col("event_type").alias("site_name"), F.col("url").alias("href2"),
        F.col("props").alias("title"), F.col("event_id").alias("pos"), F.lit(1).alias("run_no"))
    merge = ST.upsert_batches(f"{out}/state", ["site_name", "href2"], "run_no", "pos")
    ST.run_available(items.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/_chk"), out)
    return spark.read.parquet(f"{out}/state").select("run_date", "site_name", "href2", "title", "pos")


SQL_STATE = """SELECT CAST(ts AS DATE) AS run_date, event_type AS site_name,
  'https://u' || CAST(user_id AS VARCHAR) || '.example.org/' AS href2,
  arg_max(props, event_id) AS title, max(event_id) AS pos
FROM events GROUP BY 1, 2, 3"""


def q_stream_late_drop(spark, sf):
    out = ST.stream_dir(spark, "late")
    s = ST.late_drop(_events(spark, sf), CFG.run_day).select("event_id", "day", "url")
    ST.run_available(s.writeStream.format("parquet").option("path", f"{out}/data")
                     .option("checkpointLocation", f"{out}/_chk").outputMode("append"), out)
    return spark.read.parquet(f"{out}/data")


SQL_LATE = f"""SELECT event_id, CAST(ts AS DATE) AS day, 'https://u' || CAST(user_id AS VARCHAR) || '.example.org/' AS url
FROM events WHERE CAST(ts AS DATE) = DATE '{CFG.run_day}'"""


def q_stream_daily_counts(spark, sf):
    """Each batch adds its own counts to the days that it touches; the result adds them up."""
    out = ST.stream_dir(spark, "daily")
    ST.run_available(_events(spark, sf).writeStream.foreachBatch(ST.daily_counts(f"{out}/data", "event_type"))
                     .option("checkpointLocation", f"{out}/_chk"), out)
    return ST.total_counts(spark, f"{out}/data", "event_type").select(F.col("run_date").alias("day"), "event_type", "n_events")


SQL_DAILY = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events FROM events GROUP BY 1, 2"""


QUERIES = {
    "stream_seen_keys": (q_stream_seen_keys, SQL_SEEN),
    "stream_state_upsert": (q_stream_state_upsert, SQL_STATE),
    "stream_late_drop": (q_stream_late_drop, SQL_LATE),
    "stream_daily_counts": (q_stream_daily_counts, SQL_DAILY),
}
