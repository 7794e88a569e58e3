"""Streaming over several micro-batches: the events table split into three files,
one file per trigger; the results equal the batch computation."""

import tempfile

from pyspark.sql import functions as F

from newsdigest.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def _split_events(spark):
    d = tempfile.mkdtemp(prefix="nd-stream-src-")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for i, (lo, hi) in enumerate([(0, 300), (300, 700), (700, 10**9)]):
        ev.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1) \
            .write.mode("overwrite").parquet(f"{d}/part{i}")
    return d, ev.schema


def _stream(spark, d, schema):
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
         .option("recursiveFileLookup", "true").parquet(d))
    return ST.with_event_time(s).withColumn(
        "url", F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit("/")))


def test_seen_keys_and_upsert_across_batches(spark):
    d, schema = _split_events(spark)
    ev = spark.read.parquet(f"{SF}/events.parquet")

    out = ST.stream_dir(spark, "t_seen")
    ST.run_available(_stream(spark, d, schema).writeStream.foreachBatch(ST.seen_keys(f"{out}/data", "url"))
                     .option("checkpointLocation", f"{out}/_chk"), out)
    got = {(r[0], r[1]) for r in spark.read.parquet(f"{out}/data").select("run_date", "url").collect()}
    want = {(r[0], r[1]) for r in ev.select(F.to_date("ts"), F.concat(F.lit("https://u"),
                                            F.col("user_id").cast("string"), F.lit("/"))).distinct().collect()}
    assert got == want

    out2 = ST.stream_dir(spark, "t_state")
    items = _stream(spark, d, schema).select(
        F.col("day").alias("run_date"), F.col("event_type").alias("site_name"), F.col("url").alias("href2"),
        F.col("event_id").alias("pos"), F.lit(1).alias("run_no"))
    merge = ST.upsert_batches(f"{out2}/state", ["site_name", "href2"], "run_no", "pos")
    ST.run_available(items.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out2}/_chk"), out2)
    st = {(r["run_date"], r["site_name"], r["href2"]): r["pos"] for r in spark.read.parquet(f"{out2}/state").collect()}
    exp = {}
    for r in ev.select(F.to_date("ts").alias("d"), "event_type", "user_id", "event_id").collect():
        k = (r["d"], r["event_type"], f"https://u{r['user_id']}/")
        exp[k] = max(exp.get(k, -1), r["event_id"])
    assert st == exp


def test_daily_counts_independent_of_session_time_zone(spark):
    from newsdigest import queries_stream as QS
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = {(r["day"], r["event_type"]): r["n_events"] for r in QS.q_stream_daily_counts(spark, SF).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    ev = spark.read.parquet(f"{SF}/events.parquet")
    want = {(r[0], r[1]): r[2] for r in ev.groupBy(F.to_date("ts"), "event_type").count().collect()}
    assert got == want


def test_days_out_of_order_and_replayed_batches(spark):
    """Files whose days go back and forth: every event counts, every sighting is kept, once."""
    d = tempfile.mkdtemp(prefix="nd-stream-late-")
    days = [10, 20, 21, 12, 10, 21]
    rows = []
    for f, day in enumerate(days):
        own = [(f * 10 + i, f"2024-01-{day:02d} 0{i}:00:00", i + f % 2, "click" if i % 2 else "view") for i in range(5)]
        rows += [(day, r[2], r[3]) for r in own]
        (spark.createDataFrame(own, "event_id long, ts string, user_id int, event_type string")
         .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{d}/part{f}"))
    schema = spark.read.parquet(f"{d}/part0").schema

    out = ST.stream_dir(spark, "t_late")
    body = ST.daily_counts(f"{out}/data", "event_type")

    def twice(batch, batch_id):  # each batch is delivered again
        body(batch, batch_id)
        body(batch, batch_id)

    ST.run_available(_stream(spark, d, schema).writeStream.foreachBatch(twice).option("checkpointLocation", f"{out}/_chk"), out)
    got = {(r["run_date"].day, r["event_type"]): r["n_events"] for r in ST.total_counts(spark, f"{out}/data", "event_type").collect()}
    want = {}
    for day, _, kind in rows:
        want[(day, kind)] = want.get((day, kind), 0) + 1
    assert got == want and sum(got.values()) == 30

    out = ST.stream_dir(spark, "t_late_seen")
    seen = ST.seen_keys(f"{out}/data", "url")

    def again(batch, batch_id):
        seen(batch, batch_id)
        seen(batch, batch_id)

    ST.run_available(_stream(spark, d, schema).writeStream.foreachBatch(again).option("checkpointLocation", f"{out}/_chk"), out)
    found = [(r["run_date"].day, r["url"]) for r in spark.read.parquet(f"{out}/data").collect()]
    assert sorted(found) == sorted({(day, f"https://u{u}/") for day, u, _ in rows})
