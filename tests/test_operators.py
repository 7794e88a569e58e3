"""Operator truth tables and properties: dates, URLs, reposts, interleave, batches,
leader clustering against a serial emulation, captures, state."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsdigest.config import Config
from newsdigest.functions import dates as D
from newsdigest.functions import urls as U
from newsdigest.operators import dedup, filters, ordering, state
from newsdigest.sources import scans as S

RUN = dt.datetime(2022, 4, 9, 12, 0, 0)


def test_parse_date_truth_table(spark):
    cfg = Config(run_ts=RUN)
    cases = {
        "14:35": dt.date(2022, 4, 9),
        "5": dt.date(2022, 4, 5),  # free-form residue (day only) through the UDF
        "05.06.2022": dt.date(2022, 5, 6),
        "25.06.2022": dt.date(2022, 6, 25),
        "12 мая": dt.date(2022, 5, 12),
        "12 май": dt.date(2022, 5, 12),  # Q4 fixed
        "april 2022": dt.date(2022, 4, 9),
        "2022-04-05T23:30:00+03:00": dt.date(2022, 4, 5),  # no zone shift
        "": dt.date(2022, 4, 9),
        "garbage words": dt.date(2022, 4, 9),
        "31.02.2022": dt.date(2022, 4, 9),  # invalid -> run day
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", D.parse_day(F.col("s"), cfg).alias("d")).collect()}
    assert got == cases


def test_url_helpers(spark):
    df = spark.createDataFrame([
        ("https://user:pw@Host.example.com:8080/a/b?x=1#f",),
        ("vk.com/wall1",),
        ("https://t.me/chan/5",),
        ("https://web.archive.org/web/20220101000000/https://vk.com/wall-1_2",),
        ("Источник: https://a.example.org/x \t",),
    ], "u string")
    r = df.select(U.netloc("u").alias("n"), U.fix_messenger_link(F.col("u")).alias("f"),
                  U.undo_messenger_link(U.fix_messenger_link(F.col("u"))).alias("uf"),
                  U.lookup_host(F.col("u")).alias("h"), U.is_valid_url(F.col("u")).alias("v")).collect()
    assert r[0]["n"] == "user:pw@Host.example.com:8080" and r[0]["v"]
    assert r[1]["n"] == "" and not r[1]["v"]
    assert r[2]["f"] == "https://t.me/s/chan/5" and r[2]["uf"] == "https://t.me/chan/5"
    assert r[3]["h"] == "vk.com"
    assert r[4]["h"] == "a.example.org"
    res = spark.createDataFrame([("", "/x", "https://b.org"), ("", "http://z/y", "https://b.org"),
                                 ("keep", "/x", "b")], "h2 string, h string, b string")
    out = [x[0] for x in res.select(U.resolve_link("h2", "h", "b")).collect()]
    assert out == ["https://b.org/x", "http://z/y", "keep"]


def test_drop_reposts(spark):
    items = spark.createDataFrame([
        (1, "https://vk.com/wall-1_1", "plain"),
        (2, "https://vk.com/wall-1_3", 'x Reposted (<a data-post-id="-1_9">) y data-post-id="-1_1" z'),
        (3, "https://vk.com/wall-1_4", 'Reposted (<a data-post-id="-1_7">)'),
        (4, "https://vk.com/wall-1_5", 'Reposted (<a data-post-id="-1_5">)'),  # own URL only: kept
        (5, "https://t.me/wall-1_6", 'Reposted (<a data-post-id="-1_1">)'),  # other host: kept
    ], "pos long, url string, text string")
    hist = spark.createDataFrame([("https://vk.com/wall-1_7",)], "url string")
    kept = sorted(r[0] for r in filters.drop_reposts(items, hist).select("pos").collect())
    assert kept == [1, 4, 5]


def test_interleave_round_robin(spark):
    urls = ["https://a/1", "https://b/1", "https://a/2", "https://c/1", "https://a/3", "https://b/2"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos long, url string")
    out = ordering.interleave_domains(df)
    rows = out.orderBy(*ordering.interleave_sort_cols()).select("pos").collect()
    assert [r[0] for r in rows] == [0, 1, 3, 2, 5, 4]


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=230), st.integers(min_value=1, max_value=60))
def test_batch_sizes_differ_by_at_most_one(spark, n, size):
    df = spark.range(n).withColumnRenamed("id", "pos")
    out = ordering.batch_assign(df, size)
    sizes = [r[1] for r in out.groupBy("batch").count().orderBy("batch").collect()]
    assert sum(sizes) == n
    assert len(sizes) == -(-n // size)
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def _serial_leaders(n, pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    leader = {}
    for i in range(n):
        if i in leader:
            continue
        leader[i] = i
        for j in adj.get(i, ()):
            if j > i and j not in leader:
                leader[j] = i
    return leader


def test_leader_clusters_equal_serial_emulation(spark):
    rng = random.Random(7)
    n = 120
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(260)})
    df = spark.createDataFrame(pairs, "a long, b long")
    nodes = spark.range(n).withColumnRenamed("id", "idx")
    got = {r["idx"]: r["leader"] for r in dedup.assign_leaders(nodes, df).collect()}
    assert got == _serial_leaders(n, pairs)


def test_cosine_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(30)]
    docs = {}
    for d in range(60):
        base = rng.sample(vocab, 6) if d % 3 else rng.sample(vocab[:8], 6)
        docs[d] = {t: rng.randint(1, 3) for t in base}
    import math
    df_count = {}
    for terms in docs.values():
        for t in terms:
            df_count[t] = df_count.get(t, 0) + 1
    rows, vec = [], {}
    for d, terms in docs.items():
        raw = {t: c * (math.log(61 / (df_count[t] + 1)) + 1) for t, c in terms.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vec[d] = {t: v / norm for t, v in raw.items()}
        rows += [(d, t, df_count[t], v / norm) for t, v in raw.items()]
    want = set()
    for a in docs:
        for b in docs:
            if a < b and sum(vec[a][t] * vec[b].get(t, 0.0) for t in vec[a]) > 0.6:
                want.add((a, b))
    sdf = spark.createDataFrame(rows, "id long, term string, df long, w double")
    got = {(r["a"], r["b"]) for r in dedup.cosine_pairs(sdf, 0.6).collect()}
    assert got == want


def test_capture_selection(spark):
    caps = spark.createDataFrame([
        ("u1", 1, 500, None, b"a"), ("u1", 2, 200, None, b"b"), ("u1", 3, 200, None, b"c"),
        ("u2", 1, 404, None, b"x"), ("u2", 2, 503, None, b"y"),
        ("u3", 1, 404, None, b"p"), ("u3", 2, None, "timeout", None),
    ], "url string, attempt int, status int, error string, body binary")
    lst = {r["url"]: r["attempt"] for r in S.select_listing_capture(caps).collect()}
    assert lst == {"u1": 2, "u2": 2}
    art = {r["url"]: r["attempt"] for r in S.select_article_capture(caps).collect()}
    assert art == {"u1": 2, "u2": None, "u3": None}


def test_state_upsert_and_new_items(spark):
    old = spark.createDataFrame([("s", "h1", "old", 1, 1)], "site_name string, href2 string, title string, pos long, run_no int")
    run = spark.createDataFrame([("s", "h1", "new", 1, 2), ("s", "h2", "a", 2, 2), ("s", "h2", "b", 3, 2)],
                                "site_name string, href2 string, title string, pos long, run_no int")
    new = state.new_items(run, old)
    assert sorted(r["title"] for r in new.collect()) == ["a", "b"]  # duplicates inside the run kept
    up = {r["href2"]: r["title"] for r in state.upsert(old, run).collect()}
    assert up == {"h1": "new", "h2": "b"}


def test_decode_body_paths(spark):
    import gzip
    df = spark.createDataFrame([(bytearray("héllo".encode()),), (bytearray(gzip.compress("zip é".encode())),),
                                (bytearray(b"\xff\xfeab"),)], "b binary")
    out = [r[0] for r in df.select(S.decode_body(F.col("b"))).collect()]
    assert out[0] == "héllo" and out[1] == "zip é" and out[2] == "ÿþab"


def test_mojibake_repair_other_charset(spark):
    src = "Привет"
    moj = src.encode("utf-8").decode("cp1251")
    df = spark.createDataFrame([(moj,)], "s string")
    assert df.select(S.repair_mojibake(F.col("s"), "cp1251")).first()[0] == src


def test_rank_within_group_matches_window_on_a_hot_group(spark):
    from pyspark.sql import Window
    rows = [("hot", i) for i in range(500)] + [(f"g{i % 7}", i) for i in range(500, 560)] + [(None, i) for i in range(560, 600)]
    df = spark.createDataFrame(rows, "g string, pos long").repartition(5)
    got = {(r["g"], r["pos"]): r["rk"] for r in ordering.rank_within_group(df, "g", [F.col("pos")], "rk").collect()}
    want = {(r["g"], r["pos"]): r["rk"] for r in
            df.withColumn("rk", F.row_number().over(Window.partitionBy("g").orderBy("pos"))).collect()}
    assert got == want


def test_interleave_hosts(spark):
    urls = ["https://a/1", "https://b/1", "https://a/2", "https://c/1", "https://a/3", "https://b/2"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos long, url string")
    rows = ordering.interleave_domains(df).orderBy(*ordering.interleave_sort_cols()).select("pos").collect()
    assert [r[0] for r in rows] == [0, 1, 3, 2, 5, 4]


def test_canonical_domain_first_template_by_order(spark):
    from newsdigest.operators import domains
    pages = spark.createDataFrame([(1, "https://a.example.com/x"), (2, "https://example.com/y"), (3, "https://b.example.net/z"),
                                   (4, "https://other.org/"), (5, "https://bexample.net/"), (6, "")], "row_id long, url string")
    sfx = spark.createDataFrame([(1, ".example.com"), (2, "example.com"), (3, "example.net")], "ord int, template string")
    got = {r["row_id"]: r["canonical"] for r in domains.canonical_domain(pages, sfx).collect()}
    assert got == {1: ".example.com", 2: "example.com", 3: "example.net", 4: "other.org", 5: "example.net", 6: ""}


def test_keyword_counts(spark):
    docs = spark.createDataFrame([(1, "A Strike at the Mill; strikes again"), (2, None), (3, "calm day"),
                                  (4, "")], "id long, text string")
    words = spark.createDataFrame([("strike",), ("mill",), ("again",), ("nothing",), ("Strike",)], "word string")
    got = {r["id"]: (r["kw_hit"], r["n_words"]) for r in filters.keyword_counts(docs, words).collect()}
    assert got == {1: (True, 3), 2: (False, 0), 3: (False, 0), 4: (False, 0)}
