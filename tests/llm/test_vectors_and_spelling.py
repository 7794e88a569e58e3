"""Hard negatives (op11), nearest neighbours (op12) and spelling variants (op13)."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsdigest.llm import hard_negatives, nearest, spelling, vectors
from newsdigest.llm.common import table

from .conftest import edge_rows, rows

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                        *[T.StructField(c, T.StringType()) for c in ("vector", "twin", "score", "rank", "place", "code", "inner", "cell_row", "n")]])


def vector_rows(n=400, dims=20):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[30:130] = x[30]  # a third of all rows and more: one vector, and near copies of it
    x[130:200] = x[30] + rng.standard_normal((70, dims)).astype(np.float32) * np.float32(0.01)
    out = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    out += [(1000, None, 1), (1001, [nan] + [1.0] * (dims - 1), 1), (1050, [inf] * dims, 1), (1100, [None] + [1.0] * (dims - 1), 1), (1002, [0.0] * dims, 1),
            (1150, [], 2), (1003, x[7].tolist(), None), (None, x[7].tolist(), 1), (1200, [1.0, 2.0], 1), (1250, (x[9] * 1000).tolist(), 0)]
    out += [out[50], out[50], out[60], out[7]]  # repeated rows
    out += [(50, x[3].tolist(), 2), (8, x[50].tolist(), 2)]  # an id again
    return [(*r, *["x"] * 9) for r in out]


def usable(given):
    """Distinct (id, vector, label)."""
    good = {(r[0], tuple(r[1]), r[2]) for r in given if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    return sorted(good, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))


def brute_negatives(given):
    good = [(i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in usable(given) if c is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, c in good:
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, d) for j, w, d in good if j != i)
        for p, j, _ in [s for s in scored if s[2] == c][:5]:
            inside = [(j, n, s) for s, n, d in scored if d != c and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j, k, n, -p, -s) for k, (_, n, s) in enumerate(inside, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, sf, tmp_path):
    given = vector_rows()
    df = spark.createDataFrame(given, VECTORS).repartition(4)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect()
    want = brute_negatives(given)
    assert sorted(tuple(r) for r in found) == want and len(want) > 50


def test_cells_of_any_size_agree(spark, sf, monkeypatch):
    df = spark.createDataFrame(vector_rows(), VECTORS)
    asked = F.col("vec_id") % 20 == 0
    one = sorted(map(tuple, hard_negatives.mine(df, asked).collect()))
    index, dims = nearest.build(df)
    two = sorted(map(tuple, nearest.search(index, dims, index.filter(asked)).collect()))
    real = vectors.in_cells
    small = lambda *a: real(*a, row_block=37, query_block=5)
    monkeypatch.setattr(hard_negatives, "in_cells", small)
    monkeypatch.setattr(nearest, "in_cells", small)
    assert one == sorted(map(tuple, hard_negatives.mine(df, asked).collect()))
    assert two == sorted(map(tuple, nearest.search(index, dims, index.filter(asked)).collect()))


@pytest.mark.parametrize("most", [1, 300, 10_000, 40_000_000])
def test_residues_give_exact_products(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most + 1, (30, 200)), rng.integers(-most, most + 1, (40, 200))
    a[0] = b[0] = most
    b[1] = -most
    primes = hard_negatives.primes_for(200 * most * most)
    got = hard_negatives.products(*([hard_negatives.residues(x, p) for p in primes] for x in (a, b)), primes)
    assert (got == a @ b.T).all() and got[0, 0] == 200 * most * most == -got[0, 1]


def test_primes():
    assert all(p < 1024 and all(p % q for q in range(2, p)) for p in hard_negatives.PRIMES)
    assert math.prod(hard_negatives.PRIMES) > 1 << 60 and hard_negatives.SPAN * 510 ** 2 <= 1 << 24


def brute_nearest(given, is_query, k=5):
    good = sorted({(i, v) for i, v, _ in usable(given) if any(v)})
    width = max(len(v) for _, v in good)
    x = np.array([list(v) + [0.0] * (width - len(v)) for _, v in good])
    ids = np.array([i for i, _ in good])
    out = []
    for i, v in zip(ids, x):
        if is_query(i):
            score = (x * v).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((v * v).sum())
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != i][:k]
            out += [(int(i), r, round(float(score[j]), 9)) for r, j in enumerate(order, 1)]
    return sorted(out)


def test_nearest_on_odd_rows(spark, sf):
    given = vector_rows()
    index, dims = nearest.build(spark.createDataFrame(given, VECTORS).repartition(3))
    found = nearest.search(index, dims, index.filter("vec_id % 10 = 0")).collect()
    assert sorted((r.query_id, r.rank, round(r.score, 9)) for r in found) == brute_nearest(given, lambda i: i % 10 == 0)
    copies = [r.vec_id for r in found if r.query_id == 100]  # equal scores: smallest ids
    assert copies == sorted(copies) and len(copies) == 5


def test_recall_of_nearest(spark, sf):
    """On a whole table, against all cosines in double precision."""
    big = sf.replace("sf0.001", "sf0.1")
    index, dims = nearest.build(table(spark, big, "embeddings"))
    found = {(r.query_id, r.vec_id) for r in nearest.search(index, dims, index.filter("vec_id % 20 = 0")).collect()}
    x = table(spark, big, "embeddings").toPandas()
    e, ids = np.array(x.embedding.tolist(), np.float64), x.vec_id.to_numpy()
    e /= np.linalg.norm(e, axis=1)[:, None]
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        order = np.argsort(-(e @ e[i]))
        want |= {(int(ids[i]), int(ids[j])) for j in order[:6] if j != i}
    assert len(found & want) >= 0.99 * len(want)


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 48))
    turn = nearest.rotation(48, 192)
    assert np.allclose(turn.T @ turn, np.eye(48))
    code, inner = nearest.encode(x, turn)
    codes = np.ascontiguousarray(code.view(np.uint64).T)
    near, error = nearest.Query(x[0], turn).estimates(codes, np.bitwise_count(codes).sum(axis=0, dtype=np.int64), inner)
    true = x @ x[0] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[0])
    assert (np.abs(near - true) > error).mean() < 0.01 and abs((near - true).mean()) < 0.005


def test_empty_vectors(spark, sf):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("vec_id") % 50 == 0).count() == 0
    index, dims = nearest.build(none)
    assert nearest.search(index, dims, index).count() == 0


def brute_variants(counts):
    words = counts

    def one_error(a, b):
        """By definition: after the first difference, the rest agrees with a letter skipped in either or both."""
        i = len(os.path.commonprefix([a, b]))
        return a != b and (a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:])

    def near(w):
        return [v for v in words if abs(len(v) - len(w)) < 2 and one_error(w, v)]

    form, n_near = {}, {}
    for w, n in words.items():
        around = near(w)
        n_near[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, form[w], root, n_near[w], words.get(form[w])))
    return sorted(out)


def brute_words(docs):
    import re
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def as_rows(df):
    return sorted((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect())


def word_counts():
    rng = random.Random(8)
    counts = {}
    for _ in range(250):
        w = "".join(rng.choice("abéÉz") for _ in range(rng.randrange(1, 9)))
        counts[w] = rng.randrange(1, 40)
    for size in (31, 32, 33, 64, 200):
        long = "".join(rng.choice("abc") for _ in range(size))
        counts |= {long: 50, long[1:]: 20, long[:-1]: 9, long[:size // 2] + "x" + long[size // 2:]: 3, "z" + long[1:]: 50}
    counts |= {"aaaaa" + "b" * k: 2 ** (20 - k) for k in range(15)}  # a chain of forms
    counts |= {"中文字词": 9, "中文字": 2, "a\U0001f600b": 3, "ab": 9}
    return counts


@pytest.mark.parametrize("block", [4096, 7])
def test_variants_equal_brute_force(spark, sf, monkeypatch, block):
    """Also in very small blocks, with buckets of many."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    counts = word_counts()
    df = spark.createDataFrame([(w, n) for w, n in counts.items()] + [(None, 5)], "word string, n long")
    assert as_rows(spelling.variants(df)) == brute_variants(counts)


def test_one_half_shared_by_all_words(spark, sf, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = random.Random(4)
    counts = {"same" + "".join(rng.choice("abcd") for _ in range(4)): rng.randrange(1, 99) for _ in range(200)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(spelling.variants(df)) == brute_variants(counts)


def test_words_of_odd_texts(spark, sf, edge):
    extra = [(900 + i, "Café CAFÉSÉ naïve× ÿmore straße", *["x"] * 3, *["x"] * 13) for i in range(300)]
    extra = [(*r[:4], 5, *r[5:]) for r in extra] + [(5000, "q" * 30_000 + " " + "word" * 9, "en", "a", 1, *["x"] * 13)] * 3
    docs = edge.unionByName(spark.createDataFrame(extra, edge.schema))
    want = brute_words([(r[0], r[1]) for r in edge_rows() + extra])
    assert {r.word: r.n for r in spelling.words_of(docs).collect()} == want and len(want) > 3
    assert as_rows(spelling.variants(spelling.words_of(docs))) == brute_variants({w: n for w, n in want.items()})


def test_spelling_of_a_table(spark, sf):
    want = brute_words([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    found = as_rows(spelling.op13_spelling(spark, sf))
    assert [(r[0], r[1]) for r in found] == sorted(want.items())


def test_no_words(spark, sf, empty):
    assert rows(spelling.variants(spelling.words_of(empty))) == []
