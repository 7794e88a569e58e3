"""Token counts (op7), licence scans (op6), decontamination (op8), the quality classifier (op10), and words."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsdigest.llm import decontaminate, license_scan, quality, token_count
from newsdigest.llm import words as wd
from newsdigest.llm.alignment import banded_common
from newsdigest.llm.common import table

from .conftest import alnum_words, edge_rows, edge_texts, rows, words_of

BPE = public_tokenizers.path("byte_bpe_50k.json")


# words ---------------------------------------------------------------------------------------

def test_words_are_those_of_the_pattern():
    texts = edge_texts()
    arr = pa.array(["skip me", *texts], pa.string()).slice(1)
    for of, mapped, pattern in ((wd.NOT_SPACE, None, words_of), (wd.ALNUM, wd.LOWER, alnum_words)):
        seen, names = [], {}
        for low, high, text in wd.slices(arr, 3000):
            w = wd.words(text, of, mapped)
            for d in range(high - low):
                span = range(w.first[d], w.first[d + 1])
                own = [(mapped[text.data] if mapped is not None else text.data)[w.starts[i]:w.ends[i]].tobytes().decode() for i in span]
                seen.append(own)
                for i, x in zip(span, own):
                    assert names.setdefault(x, w.hashes[i]) == w.hashes[i]
        assert seen == [pattern(t) for t in texts]
        assert len(set(names.values())) == len(names)


# token counts --------------------------------------------------------------------------------

ODD = ["", " ", "\n\n  x", "don't  DON'T we'll", "<|endoftext|>", "a<|endoftext|>b", "½ ² x²", "กำ 一二三 \U0001f600 é", "\x1c\x85  x y　",
       "123456 1_000 __init__", "\t\ttabs\r\n", "  lead", "trail  ", "١٢ Ⅷ", "ẞßǅ"]


def test_token_counts_are_the_librarys(spark, edge, sf):
    tokenizer = Tokenizer.from_file(BPE)
    own = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(own, "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    found = rows(token_count.count_tokens(df, BPE))
    want = Counter((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024)
                   for i, t in own + [r[:2] for r in edge_rows()])
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == want


def test_token_counts_of_any_characters():
    rng = random.Random(2)
    proof = token_count.prove(BPE)
    assert len(proof.whole) > 40_000
    counting, tokenizer = token_count.Counting(BPE, proof), Tokenizer.from_file(BPE)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(rng.choice(points)) if rng.random() < 0.1 else rng.choice("ab Z'1.\n s") for _ in range(30)) for _ in range(1500)]
    assert counting.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_memory_is_bounded_and_parts_add_up(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 20)
    monkeypatch.setattr(token_count, "HELD", 50)
    counting, tokenizer = token_count.Counting(BPE, token_count.prove(BPE)), Tokenizer.from_file(BPE)
    texts = [t or "" for t in edge_texts()]
    assert counting.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    counting, tokenizer = token_count.Counting(path, token_count.prove(path)), Tokenizer.from_file(path)
    texts = [t or "" for t in edge_texts()[:20]]
    assert counting.count(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_an_empty_table(empty, sf):
    assert token_count.count_tokens(empty, BPE).count() == 0


# licences ------------------------------------------------------------------------------------

LICENCES = ["Released under the MIT License.", "MIT licence", "mit LICENSE mit license", "GNU General Public License", "Apache License Apache license",
            "Licensed under CC BY-NC 4.0", "the license", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and its associated documentation files to deal in the software without restriction", "Mité license", "mit-license", None, ""]


def test_licences_match_brute_force(spark, edge, sf):
    own = list(enumerate(LICENCES)) + [r[:2] for r in edge_rows()]
    found = rows(license_scan.scan(spark.createDataFrame(own, "doc_id long, text string")))
    assert len(found) == len(own)
    want = Counter()
    for i, t in own:
        w = alnum_words(t)
        places = [(at, label) for phrase, label in license_scan.BASE for at in range(len(w)) if w[at:at + len(phrase.split())] == phrase.split()]
        want[(i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in found) == want
    by_text = {t: next(r for r in found if r["doc_id"] == i) for i, t in enumerate(LICENCES)}
    assert by_text[LICENCES[5]]["labels"] == "cc-by-nc" and by_text[LICENCES[7]]["labels"] == "mit" and by_text[LICENCES[6]]["labels"] == ""
    for r in found:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_automaton_gives_matching_statistics():
    rng = random.Random(4)
    for _ in range(150):
        own = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        automaton = license_scan.SuffixAutomaton(own)
        run = [rng.randrange(5) for _ in range(25)]
        occurs = lambda x: [(s, at + len(x)) for s, o in enumerate(own) for at in range(len(o) - len(x) + 1) if o[at:at + len(x)] == x]
        longest = [max((k for k in range(end + 1) if k == 0 or occurs(run[end - k:end])), default=0) for end in range(len(run) + 1)]
        want = {(end, k) for end, k in enumerate(longest) if k >= 2 and (end == len(run) or longest[end + 1] != k + 1)}
        got = {(end, length): state for end, length, state in automaton.matches(run, 2)}
        assert set(got) == want
        for (end, length), state in got.items():
            assert automaton.ends[state] == sorted(occurs(run[end - length:end]))


def test_licences_of_an_empty_table(empty, sf):
    assert license_scan.scan(empty).count() == 0


# decontamination -----------------------------------------------------------------------------

def test_wand_finds_all_above_the_threshold():
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice([f"w{int(rng.expovariate(0.02))}", "the", "of"]) for _ in range(rng.randrange(3, 130)))) for i in range(120)]
    index = decontaminate.Index(texts)
    for threshold in (0.05, 0.2, 0.5):
        for _ in range(60):
            query = sorted(rng.sample(range(len(index.words)), 25))
            scores = defaultdict(float)
            for t in query:
                for part, share in zip(index.parts[t], index.shares[t]):
                    scores[part] += share
            want = {p: round(s, 9) for p, s in scores.items() if s >= threshold}
            _, open_blocks = index.open_blocks(np.zeros(len(query), int), np.array(query), 1, threshold)
            got = {p: round(s, 9) for b in open_blocks.tolist() for p, s in index.above(query, b, threshold)}
            assert got == want


def contamination(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "of", *(f"w{i}" for i in range(4000))]) for _ in range(n))
    items = [(i, f"{text(n)}.\n{text(5)}") for i, n in enumerate((8, 20, 40, 60, 200, 11, 30, 45))] + [(90, None), (91, ""), (None, text(20)), (93, "the of the"), (1, None)]
    items[5] = (5, items[0][1])  # a tie
    docs, want = [(0, None), (1, ""), (2, text(5000)), (3, items[4][1].split(".")[0])], {0: [], 1: [], 2: [], 3: []}
    for at in range(0, 400, 37):
        for k in (0, 1, 3, 4, 7):
            w = text(300).split()
            i = len(docs)
            docs.append((i, " ".join(w[:at]) + "\n" + items[k][1].upper() + " " + " ".join(w[at:])))
            want[i] = [0, 5] if k == 0 else [k]
    docs.append((len(docs), items[1][1] + " " + items[2][1]))
    want[len(docs) - 1] = [1, 2]
    return docs, items, want


def test_planted_items_are_found_and_others_left(spark, sf, edge):
    docs, items, want = contamination(spark)
    kinds = "doc_id long, text string", "item_id long, text string"
    found = decontaminate.find(spark.createDataFrame(docs, kinds[0]), spark.createDataFrame(items, kinds[1]).repartition(2))
    got = {r.doc_id: [i for i in r.ids] for r in found.select("row.doc_id", F.col("found.item_id").alias("ids")).collect()}
    assert got == want
    left = decontaminate.clean(edge, spark.createDataFrame(items, kinds[1]))
    assert left.columns == edge.columns and left.count() == edge.count()


def test_items_come_in_blocks(spark, sf, monkeypatch):
    docs, items, want = contamination(spark)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate.blocks(bench, 800))) > 1
    monkeypatch.setattr(decontaminate, "blocks", lambda d, most=1500, f=decontaminate.blocks: f(d, most))
    got = {r.doc_id: sorted(r.ids) for r in decontaminate.find(df, bench).select("row.doc_id", F.col("found.item_id").alias("ids")).collect()}
    assert got == want


def test_scores_do_not_depend_on_the_blocks(spark, sf, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["the", "of", *(f"w{i}" for i in range(300))]) for _ in range(n))
    items = [(i, f"{text(40)}.\n{text(6)}") for i in range(30)]
    edited = lambda t: "\n".join(" ".join("new" if rng.random() < 0.12 else w for w in p.split()) for p in t.split("\n"))
    docs = spark.createDataFrame([(i, f"{text(60)} {edited(t)} {text(60)}") for i, t in items for _ in range(4)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    result = lambda: sorted((r.row.text, sorted((f.item_id, round(f.score, 9)) for f in r.found)) for r in decontaminate.find(docs, bench).collect())
    one = result()
    assert any(0 < f[0][1] < 1 for _, f in one if f)
    monkeypatch.setattr(decontaminate, "blocks", lambda d, most=1500, f=decontaminate.blocks: f(d, most))
    assert result() == one


def test_items_without_an_id_are_reported(spark, sf, monkeypatch):
    docs, items, _ = contamination(spark)
    df, bench = spark.createDataFrame([(0, f"{items[10][1]} {items[1][1]}"), (1, docs[2][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 1500):
        monkeypatch.setattr(decontaminate, "blocks", lambda d, most=most, f=decontaminate.blocks: f(d, most))
        got = {r.doc_id: r.ids for r in decontaminate.find(df, bench).select("row.doc_id", F.array_sort("found.item_id").alias("ids")).collect()}
        assert got == {0: [1, None], 1: []}
        monkeypatch.undo()
    assert decontaminate.clean(df, bench).count() == 1


def test_short_items_in_clean_text(spark, sf):
    """The words of a short item, scattered over a clean text, are not the item."""
    items = [(1, "What is the capital? Paris."), (2, "Who wrote the long book about the sea and the whale? Melville did.")]
    docs = [(1, "what a nice day it is said the man near the river the capital letters of the sign were old and he went to paris"),
            (2, "we ask What is the capital? Paris. is the answer"), (3, "who knows the man that wrote to us on the long way home with a small book or the like about birds of the sea and how then at last the whale came up and melville at least did not"),
            (4, "quiz: Who wrote the long book about the sea and a whale? Melville did. next"), (5, "What is the capital? London is. I saw Paris.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.ids for r in decontaminate.find(df, bench).select("row.doc_id", F.array_sort("found.item_id").alias("ids")).collect()}
    assert got[1] == got[3] == [] and got[2] == [1] and got[4] == [2]


def test_decontamination_of_empty_tables(spark, empty, edge, sf):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(empty, none).count() == 0
    assert decontaminate.clean(edge, none).count() == edge.count()


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        common = d[-1][-1]
        for band in (0, 1, 3, 50):
            got = banded_common(a, b, band)
            assert got <= common and (got == common or len(a) + len(b) - 2 * common > band)


# quality -------------------------------------------------------------------------------------

def test_held_out_accuracy(spark, sf):
    sf_dir = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in rows(quality.op10_quality(spark, sf_dir))}
    assert len(found) == table(spark, sf_dir, "documents").count()
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [i for i in labels if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == labels[i] for i in held) >= 0.97 * len(held)


def test_held_out_labels_and_names_do_not_matter(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    upset = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumn("source", F.lit("s")).withColumn("lang", F.lit(None).cast("string"))
    score = lambda d, x: {r.doc_id: r.s for r in d.select("doc_id", quality.score_column(d, quality.train(d, x)).alias("s")).collect()}
    assert score(docs, labels) == score(renamed, upset)


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(0)
    x, v = rng.normal(size=(4, 9)), rng.normal(size=(9, 3))
    slow = [sum(v[i] @ v[j] * r[i] * r[j] for i in range(9) for j in range(i + 1, 9)) for r in x]
    assert np.allclose(quality.FactorisationMachine.pairs(x, v), slow)


def test_quality_of_edge_rows(spark, edge, empty, sf):
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (3, None), (None, 1), (5, 1), (6, 0), (77, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        kept = quality.accept(edge, some)
        assert kept.columns == edge.columns and kept.count() <= edge.count()
        found = edge.select(quality.score_column(edge, quality.train(edge, some)).alias("s")).collect()
        assert len(found) == edge.count() and all(0 <= r.s <= 1 and not math.isnan(r.s) for r in found)
    assert quality.accept(empty, labels).count() == 0


@pytest.mark.parametrize("columns", [["doc_id", "text"]])
def test_quality_needs_only_ids_and_texts(edge, sf, spark, columns):
    labels = spark.createDataFrame([(0, 1), (2, 0), (5, 1)], "doc_id long, quality int")
    assert quality.accept(edge.select(*columns), labels).columns == columns
