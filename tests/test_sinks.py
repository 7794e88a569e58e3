"""Sinks (K1, K2) and the model table (S12) round trips."""

import datetime as dt
import os


from newsdigest.operators import scoring, state
from newsdigest.session import ensure_checkpoint_dir

DAY = dt.date(2024, 1, 15)


def _lines(spark, path):
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    out = []
    for f in files:
        with open(os.path.join(path, f), encoding="utf-8") as fh:
            out += fh.read().splitlines()
    return out


def test_history_and_report_sinks(spark):
    base = ensure_checkpoint_dir(spark).replace("file:", "") + "/sinks"
    hist = spark.createDataFrame([(1, "https://a/1", 0.5), (2, "https://a/2", 0.9), (3, "https://a/3", 0.5)],
                                 "pos long, url string, prob double")
    state.write_history(hist, f"{base}/history", DAY)
    lines = _lines(spark, f"{base}/history/run_date={DAY}")
    assert lines == ["15/01/2024", "0.9 https://a/2", "0.5 https://a/1", "0.5 https://a/3"]
    # re-writing the day replaces only that day
    state.write_history(hist.limit(1), f"{base}/history", DAY)
    assert len(_lines(spark, f"{base}/history/run_date={DAY}")) == 2

    sites = spark.createDataFrame([(1, "s1"), (2, "s2")], "site_pos int, site_name string")
    st = spark.createDataFrame([("s1", "https://s1/b", "d", "B"), ("s1", "https://s1/a", "d", "A")],
                               "site_name string, href2 string, date string, title string")
    rep = state.report_rows(sites, st)
    state.write_report(rep, sites, f"{base}/report", DAY)
    lines = _lines(spark, f"{base}/report/run_date={DAY}")
    assert lines[0].startswith("<head>") and lines[1] == "<h2>15-01-2024 00:00</h2>"
    assert lines[2].startswith("<h2>s1</h2>") and "https://s1/a" in lines[3] and "https://s1/b" in lines[4] and lines[5] == "</table>"
    assert lines[6].startswith("<h2>s2</h2>") and "Ничего не найдено" in lines[7] and lines[8:] == ["</table>"]


def test_report_is_read_back_over_many_splits(spark):
    """Cells whose header is in an earlier split, or in an earlier file, keep their site."""
    base = ensure_checkpoint_dir(spark).replace("file:", "") + "/report-splits"
    sites = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "site_pos int, site_name string")
    rows = [(f"s{i % 2 * 3}", f"https://x/{i:04d}", "d", f"T{i}") for i in range(600)]
    st = spark.createDataFrame(rows, "site_name string, href2 string, date string, title string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        state.write_report(state.report_rows(sites, st), sites, base, DAY, "15-01-2024 09:30")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = state.read_report(spark, base, DAY).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted((r.site_name, r.href2, r.date, r.title) for r in got) == sorted(rows)


def test_model_table_round_trip(spark):
    base = ensure_checkpoint_dir(spark).replace("file:", "") + "/model"
    idf = spark.createDataFrame([("a", 1, 1.5), ("b", 2, 1.2)], "term string, df long, idf double")
    w = spark.createDataFrame([("a", 0.3)], "term string, weight double")
    scoring.save_linear_model(idf, w, -0.25, base)
    idf2, w2, b = scoring.load_linear_model(spark, base)
    assert b == -0.25
    assert {r["term"]: r["weight"] for r in w2.collect()} == {"a": 0.3, "b": 0.0}
    assert idf2.count() == 2


def test_digest_sink(spark):
    from newsdigest.plans.digest import write_digest
    base = ensure_checkpoint_dir(spark).replace("file:", "") + "/digest"
    lines = spark.createDataFrame([(2, "0.900 https://a/1"), (1, "News without duplicates:"), (3, "News with duplicates:"),
                                   (4, "-" * 30)], "line_no long, line string")
    write_digest(lines, base, DAY)
    assert _lines(spark, f"{base}/run_date={DAY}") == ["News without duplicates:", "0.900 https://a/1",
                                                      "News with duplicates:", "-" * 30]
