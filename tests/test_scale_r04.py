"""Vectors as one row each, pairs that sketches rule out together, families verified in few cells, order by the heads of texts."""

import math

from pyspark.sql import functions as F

from newsdigest.config import latin_config
from newsdigest.operators import dedup, scoring
from newsdigest.plans import digest as D

VECTORS = "id long, term string, df long, w double"


def _counted_cuts(monkeypatch, module):
    """Rows of every table that the module writes, by tag."""
    made = {}
    real = module.cut_to_parquet

    def cut(df, tag="cut"):
        out = real(df, tag)
        made.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(module, "cut_to_parquet", cut)
    return made


def test_pairs_that_only_both_sketches_rule_out_are_not_verified(spark, monkeypatch):
    """Any two rows have 70 of 100 terms in common, enough buckets for either sketch; cos is 0.7."""
    made = []
    real = dedup.dot_products
    monkeypatch.setattr(dedup, "dot_products", lambda pairs, v: made.append(pairs.count()) or real(pairs, v))
    rows = []
    for i in range(40):
        terms = [f"a{k}" for k in range(10)] + [f"own{i}-{k}" for k in range(30)] + [f"z{k}" for k in range(60)]
        rows += [(i, t, df, 0.1) for df, t in enumerate(terms)]
    rows += [(100 + i, t, df, 0.1) for i in range(2) for df, t in enumerate([f"c{k}" for k in range(90)] + [f"d{i}-{k}" for k in range(10)])]
    got = dedup.cosine_pairs(spark.createDataFrame(rows, VECTORS), 0.8).collect()
    assert [(r.a, r.b, round(r.cos, 6)) for r in got] == [(100, 101, 0.9)]
    assert sum(made) < 40  # 781 before


def test_a_family_is_verified_in_few_cells(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CELL_PAIRS", 66)
    made = _counted_cuts(monkeypatch, dedup)
    rows, pairs = [], []
    for f in range(20):
        ids = [f * 1000 + i for i in range(12)]
        rows += [(i, t, 2, w) for i in ids for t, w in ((f"f{f}", 0.8), (f"own{i}", 0.6))]
        pairs += [(a, b) for a in ids for b in ids if a < b]
    got = dedup.dot_products(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.a, r.b) for r in got} == set(pairs) and all(abs(r.cos - 0.64) < 1e-12 for r in got)
    assert max(made["wanted"]) <= 20 * 12 * 2  # a vector went to nearly every cell that it had a pair for: about 9 of 16


def test_a_family_of_many_pairs_is_a_square_of_cells(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CELL_PAIRS", 50)
    n = 60
    rows = [(i, t, 2, w) for i in range(n) for t, w in (("f", 0.8), (f"own{i}", 0.6))]
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    made = _counted_cuts(monkeypatch, dedup)
    out = dedup.dot_products(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, VECTORS))
    assert {(r.a, r.b): round(r.cos, 9) for r in out.collect()} == {p: 0.64 for p in pairs}
    assert n < made["wanted"][0] < n * 24  # not all in one cell, and not a copy for every pair


def test_packed_vectors_equal_the_exploded_ones(spark, monkeypatch):
    """Common and rare terms, texts with one kind only, terms without a weight."""
    monkeypatch.setattr(scoring, "COMMON_TERMS", 3)
    docs = {1: "aa bb cc cc dd", 2: "aa bb cc ee", 3: "rare1 rare2", 4: "aa", 5: "bb cc rare1 zz zz zz"}
    cleaned = spark.createDataFrame(list(docs.items()), "id long, cleaned string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (5, 1), (9, 0)], "doc_id long, quality int")
    terms = scoring.doc_terms(cleaned)
    idf = scoring.fit_idf(terms, 5)
    weights, b = scoring.fit_linear_model(terms, labels)
    long = scoring.tfidf_vectors(terms, idf).cache()
    packed = scoring.packed_vectors(scoring.bags(terms), idf, weights).cache()
    key = lambda d: {(r.id, r.term, r.df): r.w for r in d.collect()}
    want, got = key(long), key(scoring.unpacked(packed))
    assert want.keys() == got.keys() and all(math.isclose(want[k], got[k]) for k in want)
    order = [(r.id, list(zip(r.dfs, r.terms, strict=True))) for r in packed.collect()]
    assert len(order) == 5 and all(e == sorted(e) for _, e in order)
    ids = cleaned.select("id")
    probs = [{r.id: r.prob for r in scoring.lr_score(ids, v, weights, b).collect()} for v in (long, packed)]
    assert probs[0].keys() == probs[1].keys() and all(math.isclose(probs[0][k], probs[1][k]) for k in probs[0])


def test_text_order_meets_whole_texts_only_where_heads_are_shared(spark, monkeypatch):
    made = _counted_cuts(monkeypatch, D)
    same = "a" * 60
    texts = [(1, same + "c"), (2, "b"), (3, same + "b"), (4, same), (5, "ab"), (6, "é"), (7, same + "b\nx"), (8, "z" * 80)]
    cands = spark.createDataFrame(texts, "pos long, text string")
    found = cands.select("pos").filter("pos <> 5").withColumn("prob", F.lit(0.5))
    got = {r.pos: r.text_no for r in D.in_text_order(found, cands, latin_config()).collect()}
    texts = {p: t for p, t in texts if p != 5}
    want = sorted(texts, key=lambda p: texts[p].encode())
    assert [p for p, _ in sorted(got.items(), key=lambda x: x[1])] == want
    assert made["ties"] == [4]
