"""Benchmark decontamination: a BM25 index of test items, queried with every training passage.

Items are cut into parts of ``PART`` words and indexed: a posting is a part and the share of the
part's own score that the word gives it, so one threshold holds for all parts. Every text is
cut into passages that overlap by half, and each passage is a query. Parts are numbered by their
length and taken in blocks of ``BLOCK`` numbers; a word's greatest share in a block bounds what it
can add there. Blocks where a passage's words cannot add up to the threshold are passed over,
for all passages of a slice at once; in the others WAND walks the postings under these bounds and
gives every part above the threshold. Each item found is verified around the place: both its
question and its answer must stand there, in order, to ``OVERLAP``.

The index is broadcast in blocks of items of about ``BLOCK_BYTES``; every block sees all texts. The
statistics of the scores (parts with a word, number and mean length of parts) are those of all items,
so findings and scores do not depend on the blocks.

Defined results: null counts as empty text; items without words are never found; an item without an id is
searched and reported under a null id; an item that is
one sentence is all question; repeated rows are judged each; empty tables give no findings.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd
from .alignment import banded_common
from .common import cut, table

#: Words of an indexed part, and of a passage. A part stands whole in at least one passage.
PART, PASSAGE = 48, 128
#: A part is a candidate if the passage has this share of its own BM25 score.
THRESHOLD = 0.7
#: Share of the words of question and of answer that must stand in order around the passage.
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Parts whose postings share one upper bound.
BLOCK = 8
#: Sums of bounds (passages times blocks) that are held at a time.
HELD = 1 << 21
#: Bytes of items in one broadcast index.
BLOCK_BYTES = 4 << 20

_SENTENCE_END = re.compile(r"(?s)^(.*(?:[.?!]\s|\n))\s*(\S.*)$")


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer, what comes before it the question. An item of one
    sentence is all question."""
    m = _SENTENCE_END.match(text.rstrip())
    return (m[1], m[2]) if m else (text, "")


def in_parts(items: Sequence[tuple[int | None, str]]) -> tuple[list[tuple[int | None, list[int], list[int]]], list[tuple[int, list[int]]]]:
    """Items that have words, as (item_id, question, answer) in hashes, and their parts as (number of the item, hashes)."""
    texts = [x for _, t in items for x in question_answer(t)]
    hashes: list[list[int]] = []
    for low, high, text in wd.slices(pa.array(texts, pa.large_string())):
        w = wd.words(text, wd.ALNUM, wd.LOWER)
        hashes += [w.hashes[w.first[d]:w.first[d + 1]].tolist() for d in range(high - low)]
    some = [(i, q, a) for (i, _), q, a in zip(items, hashes[0::2], hashes[1::2]) if q or a]
    return some, [(n, (q + a)[at:at + PART]) for n, (_, q, a) in enumerate(some) for at in range(0, len(q) + len(a), PART)]


class Statistics(NamedTuple):
    """Of the parts of all items: how many there are, their mean length, and how many have each word."""

    parts: int
    mean: float
    df: Mapping[int, int]

    @classmethod
    def of(cls, parts: Sequence[tuple[int, list[int]]]) -> Statistics:
        return cls(len(parts), sum(len(p) for _, p in parts) / max(len(parts), 1), Counter(x for _, p in parts for x in set(p)))


class Index:
    """``statistics`` are those of all items and needed if ``items`` are only some of them."""

    def __init__(self, items: Sequence[tuple[int | None, str]], statistics: Statistics | None = None):
        self.items, parts = in_parts(items)
        parts.sort(key=lambda p: len(p[1]))  # parts of one block then give a word like shares
        self.item_of = [n for n, _ in parts]
        total, mean, df = statistics or Statistics.of(parts)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for part, (_, p) in enumerate(parts):
            share = {x: math.log(1 + (total - df[x] + 0.5) / (df[x] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p) / mean))
                     for x, tf in Counter(p).items()}
            whole = sum(share.values())
            for x, s in share.items():
                postings[x].append((part, s / whole))
        self.words = np.array(sorted(postings), np.uint64)
        ordered = [postings[x] for x in self.words.tolist()]
        self.parts = [[p for p, _ in o] for o in ordered]
        self.shares = [[s for _, s in o] for o in ordered]
        self.blocks = -(-len(parts) // BLOCK)
        # block entries of word t are first[t]:first[t + 1]: the block, its bound, and where its postings begin
        self.first, self.block, self.bound, self.begin = [0], [], [], []
        for own, shares in zip(self.parts, self.shares):
            for at, p in enumerate(own):
                if not at or p // BLOCK != own[at - 1] // BLOCK:
                    self.block.append(p // BLOCK)
                    self.bound.append(0.0)
                    self.begin.append(at)
                self.bound[-1] = max(self.bound[-1], shares[at])
            self.first.append(len(self.block))
        self.entries: list[dict[int, int]] = [{} for _ in range(self.blocks)]  # of each block: word -> its entry
        for t in range(len(ordered)):
            for e in range(self.first[t], self.first[t + 1]):
                self.entries[self.block[e]][t] = e
        self.at_first, self.at_block, self.at_bound = np.array(self.first), np.array(self.block, np.int64), np.array(self.bound)
        self.most = np.array([max(s) for s in self.shares])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, word numbers) of the words that the index has."""
        maybe = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(self.words) or not len(maybe):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        hit = self.words[at] == hashes[maybe]
        return maybe[hit], at[hit]

    def open_blocks(self, query: np.ndarray, word: np.ndarray, queries: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) of all blocks where the words of a query could add up to the threshold. query
        and word are pairs, in order of the query; queries are numbered from 0."""
        found = []
        step = max(1, HELD // max(self.blocks, 1))
        for low in range(0, queries, step):
            s, e = np.searchsorted(query, [low, low + step])
            n = self.at_first[word[s:e] + 1] - self.at_first[word[s:e]]
            entry = np.arange(n.sum()) + np.repeat(self.at_first[word[s:e]] - np.cumsum(n) + n, n)
            sums = np.bincount((np.repeat(query[s:e], n) - low) * self.blocks + self.at_block[entry], weights=self.at_bound[entry])
            hit = np.flatnonzero(sums >= threshold)
            found.append(np.column_stack([hit // self.blocks + low, hit % self.blocks]))
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return found[:, 0], found[:, 1]

    def above(self, query: list[int], block: int, threshold: float = THRESHOLD) -> Iterator[tuple[int, float]]:
        """WAND over one block: (part, score) of its parts that score ``threshold`` or more for the
        distinct words (numbers) of the query."""
        stop = (block + 1) * BLOCK
        # a cursor is [part, word, place in its postings, bound in this block]
        entries = self.entries[block]
        cursors = []
        for t in query:
            if t in entries:
                at = self.begin[entries[t]]
                cursors.append([self.parts[t][at], t, at, self.bound[entries[t]]])
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return
            part = cursors[pivot][0]
            if cursors[0][0] == part:
                score = sum(self.shares[c[1]][c[2]] for c in cursors if c[0] == part)
                if score >= threshold:
                    yield part, score
                part += 1
            for c in cursors[:]:
                if c[0] >= part:
                    continue
                own, at = self.parts[c[1]], c[2]
                while at < len(own) and own[at] < part:  # a block has few postings of a word
                    at += 1
                if at == len(own) or own[at] >= stop:
                    cursors.remove(c)
                else:
                    c[0], c[2] = own[at], at

    def find(self, texts: pa.Array) -> Iterator[list[tuple[int, float]]]:
        """For each text its verified items, (item_id, best score) by id."""
        half = PASSAGE // 2
        for low, high, text in wd.slices(texts):
            w = wd.words(text, wd.ALNUM, wd.LOWER)
            places, numbers = self.numbers(w.hashes)
            doc_of = w.doc_of()[places]
            # passage p of a document takes its words [p * half, p * half + PASSAGE), so a word is in two
            n = np.diff(w.first)
            passages = np.maximum(1, -(-n // half) - 1)
            first = np.concatenate([[0], np.cumsum(passages)])
            own = np.minimum((places - w.first[doc_of]) // half, passages[doc_of] - 1) + first[doc_of]
            before = ((places - w.first[doc_of]) // half >= 1) & (own > first[doc_of])
            last = (places - w.first[doc_of]) // half >= passages[doc_of]  # the last half belongs to one passage only
            before &= ~last
            words = len(self.words) or 1
            pairs = np.unique(np.concatenate([own * words + numbers, (own[before] - 1) * words + numbers[before]]))
            passage, word = pairs // words, pairs % words
            found: dict[int, dict[int, float]] = defaultdict(dict)
            # first by each word's greatest share anywhere, then by blocks
            bound = np.bincount(passage, weights=self.most[word], minlength=first[-1]) if len(pairs) else np.zeros(first[-1])
            promising = np.flatnonzero(bound >= THRESHOLD)
            kept = bound[passage] >= THRESHOLD
            word = word[kept]
            starts = np.searchsorted(passage[kept], promising)
            ends = np.searchsorted(passage[kept], promising + 1)
            query, block = self.open_blocks(np.searchsorted(promising, passage[kept]), word, len(promising))
            docs = np.searchsorted(first, promising, "right") - 1
            for k, b in zip(query.tolist(), block.tolist()):
                d = int(docs[k])
                for part, score in self.above(word[starts[k]:ends[k]].tolist(), b):
                    item = self.item_of[part]
                    start = (int(promising[k]) - int(first[d])) * half
                    if score > found[d].get(item, 0) and (item in found[d] or self.verify(w, d, start, item)):
                        found[d][item] = score
            for d in range(high - low):
                yield sorted(((self.items[item][0], score) for item, score in found[d].items()), key=_by_id) if d in found else []

    def verify(self, w: wd.Words, doc: int, start: int, item: int) -> bool:
        """Question and answer stand next to each other, each in order to ``OVERLAP``, in the passage or as far around
        it as the item is long. Words in common say by how much the text is shifted against the item; where
        enough agree on a shift, give or take the words that may differ, both parts are aligned within that band."""
        _, question, answer = self.items[item]
        whole = [*question, *answer]
        begin, end = int(w.first[doc]), int(w.first[doc + 1])
        around = w.hashes[max(begin, begin + start - len(whole)):min(end, begin + start + PASSAGE + len(whole))].tolist()
        places: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(whole):
            places[x].append(i)
        there = set(around)  # a bound first: words that are there at all
        if not all(sum(x in there for x in part) >= OVERLAP * len(part) for part in (question, answer)):
            return False
        band = math.ceil((1 - OVERLAP) * len(whole) - 1e-9)
        shifts = np.bincount([j - i + len(whole) for j, x in enumerate(around) for i in places.get(x, ())], minlength=len(around) + len(whole) + 1)
        votes = np.convolve(shifts, np.ones(2 * band + 1, np.int64), "same")
        tried = np.zeros(len(votes), bool)
        for at in np.argsort(-votes, kind="stable").tolist():
            if votes[at] < OVERLAP * len(whole) - 1e-9:
                return False
            if tried[at]:
                continue
            tried[max(0, at - band // 2):at + band // 2 + 1] = True
            at -= len(whole)
            if all(banded_common(part, near, len(near)) >= OVERLAP * len(part) for part, first in ((question, at), (answer, at + len(question)))
                   for near in [around[max(0, first - band):max(0, first + len(part) + band)]]):
                return True
        return False


def _by_id(found: tuple[int | None, float]) -> tuple[bool, int, float]:
    return found[0] is None, found[0] or 0, found[1]


def _part_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (block, item_id, text): a row of each part, with its size and a null word, and one of each word that it has."""
    for b in batches:
        for k, item, text in zip(*(c.to_pylist() for c in b.columns)):
            _, parts = in_parts([(item, text)])
            words = [x for _, p in parts for x in set(p)]
            yield pa.RecordBatch.from_arrays([
                pa.array([k] * (len(parts) + len(words)), pa.int64()),
                pa.concat_arrays([pa.nulls(len(parts), pa.int64()), pa.array(np.array(words, np.uint64).view(np.int64))]),
                pa.array([len(p) for _, p in parts] + [0] * len(words), pa.int64())], ["block", "word", "size"])


def blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[int | None, str]], Statistics]]:
    """The test items in blocks of about ``most`` bytes, each with the statistics of all items for its own words."""
    own = items.filter(F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    if n == 1:
        block = [(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]
        yield block, Statistics.of(in_parts(block)[1])
        return
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    counts = cut(own.select("block", "item_id", "text").mapInArrow(_part_words, "block long, word long, size long")
                 .groupBy("block", "word").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size")), "item-words")
    whole = counts.filter("word is null").agg(F.sum("parts").alias("parts"), F.sum("size").alias("size")).first()
    words = counts.filter("word is not null")
    words = cut(words.select("block", "word").join(words.groupBy("word").agg(F.sum("parts").alias("df")), "word"), "item-word-parts")
    parts = whole.parts or 0
    for k in range(n):
        df = {r.word & 0xFFFFFFFFFFFFFFFF: r.df for r in words.filter(F.col("block") == k).select("word", "df").collect()}
        yield ([(r.item_id, r.text) for r in own.filter(F.col("block") == k).orderBy("item_id", "text").collect()],
               Statistics(parts, (whole.size or 0) / max(parts, 1), df))


_FOUND = "array<struct<item_id: long, score: double>>"


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Two columns: ``row``, a struct of docs' own columns, and ``found``, an array of (item_id, score)."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.expr(f"cast(array() as {_FOUND})").alias("found"))
    for k, (block, statistics) in enumerate(blocks(items)):
        if k:  # one index at a time in a worker
            out = cut(out, "decontaminated")
        search = _search(docs.sparkSession.sparkContext.broadcast(Index(block, statistics)))
        out = out.select("row", F.concat("found", search(F.col("row.text"))).alias("found"))
    return out


def _search(shipped):
    @F.arrow_udf(_FOUND)
    def search(texts: pa.Array) -> pa.Array:
        rows = [[{"item_id": i, "score": s} for i, s in r] for r in shipped.value.find(texts)]
        return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())])))

    return search.asNondeterministic()  # so a filter on the result does not search twice


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, table(spark, sf_dir, "benchmark")).select(
        "row.doc_id", (F.size("found") > 0).alias("contaminated"), F.array_sort(F.array_distinct("found.item_id")).alias("item_ids"),
        F.coalesce(F.array_max("found.score"), F.lit(0.0)).alias("best_score"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item, with docs' own columns."""
    return find(docs, items).filter(F.size("found") == 0).select("row.*")
