"""Names of several tokens (T3): leftmost, then longest."""

import random

from newsdigest.operators.lexicon import mask_spans


def brute(tokens, names):
    out, i = [], 0
    while i < len(tokens):
        n = max((n for n in range(1, len(tokens) - i + 1) if " ".join(tokens[i:i + n]) in names), default=0)
        out += [names[" ".join(tokens[i:i + n])]] * n if n else [tokens[i]]
        i += n or 1
    return out


def test_spans_equal_brute_force(spark):
    rng = random.Random(12)
    names = {" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))): f"_{k % 3}" for k in range(14)}
    docs = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(0, 25))]) for i in range(150)] + [(900, None)]
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    gazetteer = spark.createDataFrame([*names.items(), (None, "x"), (" ", "x"), ("e  f", "_ef"), ("e f", "_eg")], "surface string, replacement string")
    got = {r["id"]: r["tokens"] for r in mask_spans(df, gazetteer).collect()}
    assert got.pop(900) is None
    assert got == {i: brute(t, names | {"e f": "_ef"}) for i, t in docs if t is not None}
