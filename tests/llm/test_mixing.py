"""Mixing (op9)."""

from collections import Counter, defaultdict

from newsdigest.llm import mixing
from newsdigest.llm.common import table

from .conftest import edge_rows, rows, words_of


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Give by weight, stop at the cap, share the rest again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in above)
        free -= above
    return target


def check(found, docs):
    """docs: (doc_id, source, words)."""
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
        largest[s] = max(largest[s], n)
    target = brute_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter(docs)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6, (s, taken[s], t)


def test_mix_of_edge_rows(edge):
    check(rows(mixing.mix(edge)), [(r[0], r[3], len(words_of(r[1]))) for r in edge_rows()])


def test_mix_meets_targets_and_reruns_agree(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = rows(mixing.mix(docs))
    check(found, [(r.doc_id, r.source, len(words_of(r.text))) for r in docs.collect()])
    again = rows(mixing.mix(docs.repartition(7)))
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_caps_and_small_fans(spark):
    """One source is far too small for its weight; folds of few documents make a deep tree."""
    docs = [(i, "a", "x " * (1 + i % 9)) for i in range(400)] + [(1000 + i, "c", "y " * 5) for i in range(3)] + [(2000, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    check(rows(mixing.mix(df)), [(i, s, len(words_of(t))) for i, s, t in docs])
    narrow = mixing.sized(df).selectExpr("doc_id", "0L AS tag", "source", "size", "1L AS nth")
    found = rows(mixing.round_copies(narrow, mixing.targets(narrow), fan_in=3))
    target = brute_targets({"a": sum(1 + i % 9 for i in range(400)), "c": 15, None: 0})
    assert len(found) == len(docs)
    assert abs(sum(r["copies"] * r["size"] for r in found if r["source"] == "a") - target["a"]) <= 4.5


def test_take_repeats_whole_rows(edge):
    drawn = rows(mixing.mix(edge))
    got = mixing.take(edge)
    assert got.columns == edge.columns
    copies = Counter()
    for r in drawn:
        copies[(r["doc_id"], r["tag"], r["source"])] += r["copies"]
    # equal ids, texts and sources: as many rows as their copies; other rows as often as drawn
    got_rows = Counter(tuple(r) for r in got.collect())
    assert set(got_rows) <= set(edge_rows())
    tags = {r["doc_id"]: r["tag"] for r in drawn}
    by = Counter()
    for r, n in got_rows.items():
        by[(r[0], r[1], r[3])] += n
    want = Counter()
    for r in {(r[0], r[1], r[3]) for r in edge_rows()}:
        ids = [k for k in copies if k[0] == r[0] and k[2] == r[2]]
        if len(ids) == 1 and copies[ids[0]]:
            want[r] = copies[ids[0]]
            assert by[r] == want[r]
    assert len(want) > 20 and tags and sum(got_rows.values()) == sum(copies.values())


def test_take_of_repeated_rows_meets_the_target(spark):
    """Equal rows are drawn each by its own number."""
    docs = [(1, "a", "x " * 10)] * 600 + [(2 + i, "b", "y " * 10) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
    found = rows(mixing.mix(df))
    check(found, [(i, s, 10) for i, s, _ in docs])
    taken = Counter(r["source"] for r in rows(mixing.take(df)))
    assert abs(taken["a"] * 10 - 4000) <= 5 and abs(taken["b"] * 10 - 8000) <= 5
    narrow = mixing.numbered(spark.createDataFrame([(1, 2, "a", 3)] * 10_000, "doc_id long, tag long, source string, size long"))
    assert sorted(r["nth"] for r in rows(narrow)) == list(range(1, 10_001))


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
