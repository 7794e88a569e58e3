"""Pairs that sketches rule out, pages in small batches, hosts that hold most rows."""

import math

import pandas as pd
from pyspark.sql import functions as F

from newsdigest.operators import dedup, domains
from newsdigest.sources import html as H
from newsdigest.sources import scans as S

VECTORS = "id long, term string, df long, w double"


def _rows(rows):
    out = []
    for i, v in rows.items():
        length = math.sqrt(sum(w * w for w, _ in v.values()))
        out += [(i, t, df, w / length) for t, (w, df) in v.items()]
    return out


def test_one_shared_rare_term_asks_for_no_verification(spark, monkeypatch):
    made = []
    real = dedup.dot_products
    monkeypatch.setattr(dedup, "dot_products", lambda pairs, v: made.append(pairs.count()) or real(pairs, v))
    rows = {i: {"rare": (1.0, 2), **{f"w{i}-{k}": (1.0, 9) for k in range(30)}} for i in range(60)}
    rows |= {100 + i: {f"f{k}": (1.0, 5) for k in range(20)} | {f"own{i}": (0.5, 9)} for i in range(5)}
    got = dedup.cosine_pairs(spark.createDataFrame(_rows(rows), VECTORS), 0.8).collect()
    assert {(r.a, r.b) for r in got} == {(100 + i, 100 + j) for i in range(5) for j in range(i + 1, 5)}
    assert all(abs(r.cos - 20 / 20.25) < 1e-9 for r in got)
    assert sum(made) < 60  # all 1770 pairs of the rows that share "rare" before


def test_dot_products_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CELL_PAIRS", 10)
    rows = _rows({i: {f"t{(i * k) % 7}": (1.0 + k, 3) for k in range(1, 5)} for i in range(20)})
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)]
    got = dedup.dot_products(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, VECTORS))
    unit = {i: {t: w for j, t, _, w in rows if j == i} for i in range(20)}
    want = {(a, b): sum(w * unit[b].get(t, 0.0) for t, w in unit[a].items()) for a, b in pairs}
    got = {(r.a, r.b): r.cos for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_pages_leave_python_in_small_batches():
    n = 300
    pages = pd.DataFrame({"page_id": range(n), "html": ["<p>a</p>" * 2000] * 20 + ["<p>b</p>"] * (n - 22) + [None, ""]})
    for mapped in (H.map_events, H.map_xml):
        out = list(mapped([pages]))
        assert max(len(b) for b in out) <= H.BATCH_ROWS and all(b["events"].map(len).sum() < 50000 for b in out)
        whole = pd.concat(out)
        assert whole["page_id"].to_list() == list(range(n)) and whole["events"].map(len).sum() == 20 * 4000 + (n - 22) * 2
        assert len(list(mapped([pages.head(0)]))) <= 1


def test_texts_are_repaired_one_by_one(spark):
    df = spark.createDataFrame([("Ã©", "ISO-8859-1"), ("xя", "ISO-8859-1"), ("same", None), (None, "UTF-8")], "t string, c string")
    assert [r[0] for r in df.select(S.repair_mojibake(F.col("t"), F.col("c"))).collect()] == ["é", "", "same", None]


def test_a_host_with_all_rows_is_dealt_to_many_tasks(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://t.me/s/c/"), F.col("id")).alias("url"))
    suffixes = spark.createDataFrame([(1, "t.me"), (2, "me")], "ord int, template string")
    rules = spark.createDataFrame([("t.me", "r")], "netloc string, rule string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = domains.route_rules(domains.canonical_domain(pages, suffixes, "url", "page_id"), rules)
        got = out.withColumn("task", F.spark_partition_id()).agg(
            F.count("*"), F.countDistinct("page_id"), F.countDistinct("task"), F.bool_and(F.col("has_rule") & (F.col("canonical") == "t.me"))).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got[0] == 4000 and got[1] == 4000 and got[2] > 2 and got[3]
