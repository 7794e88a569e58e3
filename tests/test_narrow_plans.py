"""Keyword lists by joins (F1), and the digest's distinct texts on narrow rows (A1)."""

import random

from pyspark.sql import functions as F

from newsdigest.config import latin_config
from newsdigest.operators import filters
from newsdigest.plans import digest as D

CFG = latin_config()


def test_keyword_counts_equal_a_scan_of_every_text(spark):
    rng = random.Random(5)
    letters = "abcdé語"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    blank = lambda: rng.choice([" ", "  ", "\n", "\t "])
    texts = ["".join(word() + blank() for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "", "   ", "ABC Def", "a" * 5000]
    rows = list(enumerate(texts)) + [(3, "abc"), (3, "abc"), (3, "dab"), (None, "abcd a"), (None, None), (4, texts[4])]
    words = [word() for _ in range(60)] + [word() + " " + word() for _ in range(40)] + [" a b ", "c  d", "A", "ABC", "abc", "", "  ", None, "zzz", "aaaa"]
    df = spark.createDataFrame(rows, "id long, text string")
    got = filters.keyword_counts(df, spark.createDataFrame([(w,) for w in words], "word string")).collect()
    own = {w.strip().lower() for w in words if w and w.strip()}
    want = [(i, n > 0, n) for i, n in ((i, sum(w in (t or "").lower() for w in own)) for i, t in rows)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(" " in w and any(w in (t or "").lower() for _, t in rows) for w in own)


def test_keyword_counts_of_empty_tables(spark):
    none = spark.createDataFrame([], "word string")
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    assert [tuple(r) for r in filters.keyword_counts(rows, none).collect()] == [(1, False, 0)]
    assert filters.keyword_counts(rows.limit(0), spark.createDataFrame([("a",)], "word string")).count() == 0


def _candidates(spark):
    rows = [(i, f"https://{'a' if i % 3 else 'b'}.org/{i}", CFG.run_day if i % 7 else None, text)
            for i, text in enumerate(["one", "two", "one", " ", "three", None, "two", "one", "", "four", "two", " ", "three"] * 3)]
    return spark.createDataFrame(rows, "pos long, url string, day date, text string"), rows


def test_distinct_candidates_are_the_first_rows_in_interleave_order(spark):
    cands, rows = _candidates(spark)
    hosts = {}
    for pos, url, _, _ in rows:
        hosts.setdefault(url.split("/")[2], []).append(pos)
    visit = sorted(hosts.values(), key=lambda p: (-len(p), p[0]))
    order = {p: (r, h) for h, ps in enumerate(visit) for r, p in enumerate(ps)}
    first = {}
    for pos, _, day, text in sorted(rows, key=lambda r: order[r[0]]):
        if day and text and text.strip():
            first.setdefault(text, pos)
    got = D.resolved_texts(cands, None, CFG).collect()
    assert {(r.text, r.pos) for r in got} == set(first.items())


def test_no_text_is_shuffled_to_tell_texts_apart(spark):
    cands, _ = _candidates(spark)
    plan = D.distinct_candidates(cands, None, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    sides = D.distinct_candidates(cands.withColumn("text", F.concat("text", F.lit("!"))), None, CFG)
    exchanged = [line for line in sides._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert exchanged and all("text" not in line for line in exchanged)
