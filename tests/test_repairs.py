"""Bytes to text, mojibake, blanks, dates, ingest positions and stream state on the inputs that go wrong."""

import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from newsdigest.config import latin_config
from newsdigest.functions import dates, text
from newsdigest.operators import dedup
from newsdigest.plans import ingest as I
from newsdigest.sources import scans
from newsdigest.streaming import stream as ST


def _one(spark, rows, schema, column):
    return [r.x for r in spark.createDataFrame(list(enumerate(rows)), f"i int, v {schema}").select("i", column.alias("x")).orderBy("i").collect()]


def test_bodies(spark):
    bodies = ["é".encode(), "é".encode("latin-1"), gzip.compress("é".encode()), gzip.compress("é".encode("latin-1")), b"\x1f\x8bno gzip\xff", None, b""]
    want = ["é", "é", "é", "é", b"\x1f\x8bno gzip\xff".decode("latin-1"), None, ""]
    assert _one(spark, bodies, "binary", scans.decode_body(F.col("v"))) == want


def test_mojibake(spark):
    texts = ["привет".encode().decode("latin-1"), "я", "é abc", "abc", None, "", "e\u0301".encode().decode("latin-1")]
    assert _one(spark, texts, "string", scans.repair_mojibake(F.col("v"), "ISO-8859-1")) == ["привет", "", " abc", "abc", None, "", "e\u0301"]


def test_unicode_blanks(spark):
    assert _one(spark, ["a\n\u00a0\nb\nc\n\u2003 \nd\ne"], "string", text.head(text.paragraphs("v"), 4)) == [["a", "b", "c", "d"]]
    assert _one(spark, ["\u00a0 \n", "x"], "string", text.has_text("v")) == [False, True]


def test_iso_dates_end_where_a_date_ends(spark):
    cfg = latin_config()
    got = _one(spark, ["2022-04-05", "2022-04-05T23:30:00+03:00", "2022-04-05 10:00", "2022-04-05garbage"], "string", F.col("v"))
    df = dates.with_day(spark.createDataFrame(list(enumerate(got)), "i int, v string"), "v", "day", cfg)
    days = [str(r.day) for r in df.orderBy("i").collect()]
    assert days == ["2022-04-05"] * 3 + [str(cfg.run_day)]


def test_pages_of_many_items_keep_their_order(spark):
    items = "".join(f'<li><a href="/same">The {i}</a></li>' for i in range(1500))
    pages = spark.createDataFrame([(1, "https://a.org/", f"<ul>{items}</ul>"), (2, "https://a.org/", '<ul><li><a href="/same">The last</a></li></ul>')],
                                  "page_id long, url string, html string")
    sites = spark.createDataFrame([(1, "a.org")], "site_pos long, site_name string")
    state, _ = I.ingest(pages, None, sites, latin_config(), ["the"])
    assert [(r.href2, r.title) for r in state.collect()] == [("https://a.org/same", "The last")]


def test_pairs_do_not_trust_a_stored_df(spark):
    rows = [(i, t, 1, w) for i in (1, 2) for t, w in (("x", 0.6), ("y", 0.8))]
    got = dedup.cosine_pairs(spark.createDataFrame(rows, "id long, term string, df long, w double"), 0.8).collect()
    assert [(r.a, r.b, round(r.cos, 6)) for r in got] == [(1, 2, 1.0)]


def _batch(spark, day, n):
    return spark.createDataFrame([(day, "s", f"u{i}", i, 1) for i in range(n)], "run_date date, site_name string, href2 string, pos long, run_no int")


def test_state_that_cannot_be_read_fails_the_batch(spark):
    import datetime
    path = f"{ST.stream_dir(spark, 'broken')}/state"
    merge = ST.upsert_batches(path, ["site_name", "href2"], "run_no", "pos")
    day, other = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    merge(_batch(spark, day, 5), 0)
    merge(_batch(spark, other, 2), 1)
    merge(_batch(spark, day, 7), 2)
    assert spark.read.parquet(path).groupBy("run_date").count().orderBy("run_date").collect() == [(day, 7), (other, 2)]
    local = path.removeprefix("file:")
    for d, _, files in os.walk(local):
        for f in files:
            if f.endswith(".parquet") and "2024-01-01" in d:
                open(f"{d}/{f}", "wb").write(b"broken")
                if os.path.exists(f"{d}/.{f}.crc"):
                    os.remove(f"{d}/.{f}.crc")
    with pytest.raises(Exception):
        merge(_batch(spark, day, 1), 3)


def test_seen_keys_leave_the_state(spark):
    source = tempfile.mkdtemp(prefix="nd-seen-")
    days = [f"2024-01-{d:02d} 10:00:00" for d in (1, 2, 3, 10, 11, 20)]
    for k, d in enumerate(days):
        spark.sql(f"SELECT timestamp_ntz'{d}' AS ts, id AS user_id FROM range(5)").coalesce(1).write.parquet(f"{source}/p{k}")
    events = ST.with_event_time(spark.readStream.schema("ts timestamp_ntz, user_id long").option("maxFilesPerTrigger", 1)
                                .option("recursiveFileLookup", "true").parquet(source))
    out = ST.stream_dir(spark, "seen")
    q = ST.run_available(events.writeStream.foreachBatch(ST.seen_keys(f"{out}/data", "user_id")).option("checkpointLocation", f"{out}/_chk"), out)
    # the state is the day partitions; no operator holds keys in memory
    assert not any(p.stateOperators for p in q.recentProgress)
    assert spark.read.parquet(f"{out}/data").count() == 5 * len(days)


def _train_score(spark, folder, docs, labels):
    from newsdigest.queries_plans import q_lr_train_score
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r.doc_id: r.prob for r in q_lr_train_score(spark, str(folder)).collect()}


def test_training_reads_all_paragraphs(spark, tmp_path):
    plain = "\n".join(["same words here"] * 6)
    docs = [(i, f"{plain}\n{'crystal' if i % 2 else 'granite'}") for i in range(12)] + [(12, f"{plain}\ncrystal"), (13, f"{plain}\ngranite"), (14, None)]
    got = _train_score(spark, tmp_path, docs, [(i, i % 2, 0) for i in range(12)])
    assert len(got) == 15 and got[12] > 0.6 and got[13] < 0.4


def test_training_keeps_rare_terms(spark, tmp_path):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "q" + "".join(letters[n // 26 ** k % 26] for k in range(4))
    # more words that occur twice, under both labels, than a default vocabulary (262,144 words) holds, and one that occurs once
    docs = [(i, " ".join(word(n) for n in range(i // 2 * 30_000, (i // 2 + 1) * 30_000))) for i in range(18)]
    docs += [(18, "crystal"), (19, "crystal"), (20, ""), (21, "")]
    got = _train_score(spark, tmp_path, docs, [(i, i % 2, 0) for i in range(18)] + [(18, 1, 0), (21, 0, 0)])
    assert got[19] > got[20] + 0.01
