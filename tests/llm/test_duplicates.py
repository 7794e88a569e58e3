"""Near-duplicates (op1) and substring dedup (op2)."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from newsdigest.llm import near_dup, substring_dedup
from newsdigest.llm import words as wd
from newsdigest.llm.common import table
from newsdigest.llm.components import components

from .conftest import ASCII_LOWER, edge_rows, rows, words_of


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def shingles(text):
    w = words_of((text or "").translate(ASCII_LOWER))
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def brute_classes(docs):
    """All pairs of different texts, by alignment of shingles; [(id, class, size, kept)]."""
    groups, union = defaultdict(list), Union()
    for i, t in docs:
        groups[tuple(shingles(t))].append(i)
    texts = [s for s in groups if s]
    for k, a in enumerate(texts):
        for b in texts[:k]:
            n = len(a) + len(b)
            bound = sum((Counter(a) & Counter(b)).values())
            if bound >= 0.8 * (n - bound) and (m := common(a, b)) >= 0.8 * (n - m):
                union.join(a, b)
    classes = defaultdict(list)
    for s in texts:
        classes[union.find(s)] += groups[s]
    out = Counter((i, i, 1, True) for i in groups.get((), []))
    for ids in classes.values():
        least = min((i for i in ids if i is not None), default=None)
        out.update((i, least, len(ids), i == least) for i in ids)
    return out


def got_classes(df):
    return Counter((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in rows(near_dup.classes(df)))


def test_classes_of_edge_rows(edge, sf):
    assert got_classes(edge) == brute_classes([r[:2] for r in edge_rows()])


def test_classes_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert got_classes(docs) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def mutated(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**9)}"
    return words


def test_chains_large_groups_and_a_common_passage(spark, sf):
    """A chain whose ends are far apart, a group of near copies of one text, and short documents that share
    most of their words but are not similar."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, chain = [], text(150)
    for _ in range(25):
        docs.append(" ".join(chain))
        chain = mutated(rng, chain, 2)
    base, passage = text(120), text(60)
    docs += [" ".join(mutated(rng, base, 1)) for _ in range(60)]
    docs += [" ".join(text(10) + passage + text(10)) for _ in range(60)]
    docs += [" ".join(text(4) + passage + text(5)) for _ in range(40)]
    rng.shuffle(docs)
    own = list(enumerate(docs))
    assert got_classes(spark.createDataFrame(own, "doc_id long, text string").repartition(4)) == brute_classes(own)


def test_order_counts(spark, sf):
    rng = random.Random(3)
    w = [f"w{i}" for i in range(200)]
    swapped = w[100:] + w[:100]
    moved = w[:20] + w[22:60] + w[20:22] + w[60:]
    docs = [" ".join(w), " ".join(swapped), " ".join(moved), " ".join(rng.sample(w, 200))]
    found = {r["doc_id"]: r["class_id"] for r in rows(near_dup.classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")))}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3}


def test_keep_one(spark, edge, sf, empty):
    kept = near_dup.keep_one(edge)
    assert kept.columns == edge.columns
    want = Counter((i, c) for (i, c, _, k) in brute_classes([r[:2] for r in edge_rows()]) if k)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in want)
    assert near_dup.keep_one(empty).count() == 0 and near_dup.classes(empty).count() == 0


def test_recall_of_the_keys():
    rng = random.Random(9)
    missed = pairs = 0
    for n in [20, 40, 80, 200] * 60:
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = mutated(rng, a, max(1, n // 50))
        w = wd.words(next(wd.slices(pa.array([" ".join(a), " ".join(b)])))[2])
        found, first = near_dup.shingles(w.hashes, w.first)
        if near_dup.is_similar(found[:first[1]], found[first[1]:]):
            pairs += 1
            keys = near_dup.sketches(found, first)
            missed += not (keys[0] == keys[1]).any()
    assert pairs > 100 and missed == 0


def test_similarity_is_that_of_the_full_alignment():
    rng = random.Random(10)
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(40)) if rng.random() < 0.5 or len(b) < 2 else b.pop(rng.randrange(len(b)))
        m = common(a, b)
        assert near_dup.is_similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (m >= 0.8 * (len(a) + len(b) - m) - 1e-9)


def test_components_of_stars_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 40)] + [(5, 5), (7, 10), (300, 200), (200, 300)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    least = {}
    for x in union.up:
        least[union.find(x)] = min(x, least.get(union.find(x), x))
    want = {x: least[union.find(x)] for x in union.up if least[union.find(x)] != x}
    got = rows(components(spark.createDataFrame(edges, "a long, b long")))
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# substrings ----------------------------------------------------------------------------------

def brute_substrings(docs, window=13):
    first = {}
    split = [(i, words_of(t)) for i, t in docs]
    for i, w in split:
        if i is not None:
            for at in range(len(w) - window + 1):
                x = tuple(w[at:at + window])
                first[x] = min(first.get(x, math.inf), i)
    out = Counter()
    for i, w in split:
        gone = set()
        if i is not None:
            for at in range(len(w) - window + 1):
                if first[tuple(w[at:at + window])] < i:
                    gone.update(range(at, at + window))
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    return out


def got_substrings(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.dedup(df)))


def test_substrings_of_edge_rows(edge, sf):
    assert got_substrings(edge) == brute_substrings([r[:2] for r in edge_rows()])


def test_substrings_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert got_substrings(docs) == brute_substrings([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 10, 1000])
def test_substrings_of_few_and_many_words(spark, sf, vocabulary):
    """Runs, short periods, passages of 12, 13 and more words at all places, some in many documents."""
    rng = random.Random(vocabulary)
    text = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    passages = [text(n) for n in (12, 13, 14, 30)]
    docs = []
    for i in range(60):
        w = text(rng.randrange(0, 40))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        docs.append((rng.randrange(10**6) if i % 9 else i, " ".join(w)))
    assert got_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute_substrings(docs)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(7)
    for vocabulary in (1, 2, 5, 500):
        seen = {}
        shared = [f"w{rng.randrange(vocabulary)}" for _ in range(40)]
        texts = [" ".join([f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(20))] + shared[rng.randrange(20):]
                          + [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(20))]) for _ in range(80)]
        for low, high, text in wd.slices(pa.array(texts), 2000):
            w = wd.words(text)
            starts, anchor = substring_dedup.anchors(w)
            for s, a in zip(starts.tolist(), anchor.tolist()):
                assert seen.setdefault(tuple(w.hashes[s:s + 13].tolist()), a) == a


def test_no_substrings(empty, sf):
    assert substring_dedup.dedup(empty).count() == 0


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_texts_made_to_collide(spark, sf):
    """Two words in Thue-Morse order, and swapped: polynomials modulo 2^64 agree whatever their base."""
    one = " ".join("ab"[b] + f" c{i}" for i, b in enumerate(thue_morse(2048)))
    two = " ".join("ba"[b] + f" c{i}" for i, b in enumerate(thue_morse(2048)))
    long = ["".join("ab"[b ^ k] for b in thue_morse(4096)) for k in (0, 1)]
    docs = spark.createDataFrame([(1, one), (2, two), (3, long[0]), (4, long[1]), (5, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in rows(near_dup.classes(docs))} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert {r["doc_id"]: r["n_removed"] for r in rows(substring_dedup.dedup(docs))} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 4096}


def test_classes_without_ids(spark, sf):
    text = " ".join(f"w{i}" for i in range(100))
    docs = [(None, text), (None, text + " more"), (None, "other words of another text stand here"), (None, None), (4, "x y z"), (None, "x y z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = rows(near_dup.classes(df))
    assert sorted(r["class_size"] for r in found) == [1, 1, 2, 2, 2, 2]
    kept = Counter((r["doc_id"], r["text"]) for r in rows(near_dup.keep_one(df)))
    assert len(kept) == 4 and kept[(4, "x y z")] == 1 and (None, "x y z") not in kept


@pytest.mark.parametrize("block", [512, 20])
def test_family_of_far_copies(spark, sf, monkeypatch, block):
    """Copies of one text with a few words changed each: most pairs are below the similarity, and what links is
    found by components, in blocks of any size."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(17)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(120)] = f"x{i}-{rng.randrange(99)}"
        docs.append((i, " ".join(own)))
    docs += [(1000 + i, " ".join(base[:40]) + " " + " ".join(f"y{i}-{k}" for k in range(60))) for i in range(40)]  # a passage in common
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got_classes(df) == brute_classes(docs)


def test_labels_in_common():
    rng = np.random.default_rng(2)
    a, b = ([rng.choice(300, rng.integers(0, 60), False) for _ in range(n)] for n in (13, 9))
    for columns in (4096, 7):
        assert (near_dup._in_common(a, b, columns) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
