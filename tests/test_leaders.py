"""Greedy leaders from vectors, without all pairs (A5)."""

import math
import random

import pytest

from newsdigest.operators import dedup


def vectors(spark, rows):
    """rows: id -> {term: weight}; unit length, df over the rows."""
    df = {}
    for v in rows.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    out = []
    for i, v in rows.items():
        length = math.sqrt(sum(w * w for w in v.values()))
        out += [(i, t, df[t], w / length) for t, w in v.items()]
    return spark.createDataFrame(out, "id long, term string, df long, w double")


def serial(rows, ksim):
    unit = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in rows.items()}
    leader = {}
    for i in sorted(unit):
        led = (j for j in sorted(leader) if leader[j] == j and sum(w * unit[j].get(t, 0) for t, w in unit[i].items()) > ksim)
        leader[i] = next(led, i)
    return leader


def found(spark, rows, ksim):
    return {r["id"]: r["leader"] for r in dedup.greedy_leaders(vectors(spark, rows), ksim).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_the_serial_loop(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for i in range(160):
        if rows and rng.random() < 0.7:  # a copy of an earlier row with a few terms changed: chains and families
            v = dict(rows[rng.choice(list(rows))])
            for _ in range(rng.randrange(0, 3)):
                v.pop(rng.choice(list(v)), None)
                v[f"t{rng.randrange(400)}"] = rng.choice([0.5, 1.0, 2.0])
        else:
            v = {f"t{rng.randrange(400)}": rng.choice([0.5, 1.0, 2.0]) for _ in range(8)}
        rows[rng.randrange(10**9)] = v
    want = serial(rows, 0.75)
    assert found(spark, rows, 0.75) == want and 10 < len(set(want.values())) < 150


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each row is similar to the one before and after it only."""
    rounds = []
    real = dedup._ends_of_chains
    monkeypatch.setattr(dedup, "_ends_of_chains", lambda s: rounds.append(1) or real(s))
    n = 120
    rows = {i: {f"t{i}": 1.0, f"t{i + 1}": 1.0} for i in range(n)}
    assert found(spark, rows, 0.45) == {i: i - i % 2 for i in range(n)}
    assert len(rounds) <= 6


def test_a_family_costs_no_square(spark, monkeypatch):
    """5,000 near copies: pairs with the leader, not with each other."""
    made = []
    real = dedup.similar_pairs

    def counted(*a):
        out = real(*a).cache()
        made.append(out.count())
        return out

    monkeypatch.setattr(dedup, "similar_pairs", counted)
    m = 5000
    rows = {i: {**{f"f{k}": 1.0 for k in range(20)}, f"own{i}": 1.0} for i in range(m)}
    rows |= {m + i: {f"f{i % 20}": 1.0, f"x{i}": 1.0, f"y{i % 7}": 1.0} for i in range(50)}
    got = found(spark, rows, 0.8)
    assert all(got[i] == 0 for i in range(m)) and all(got[m + i] == m + i for i in range(50))
    assert sum(made) < 12 * m
