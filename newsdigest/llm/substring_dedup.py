"""Substring dedup by recompression.

A text is a string of words. Recompression replaces, in rounds, maximal runs of a symbol by one
symbol and then neighbouring pairs by one symbol: a coin that depends on the symbol puts each
symbol left or right, and each left symbol followed by a right one becomes a pair. A name is a fingerprint of
what it stands for, so names are the same in every task and need no dictionary. Whether a symbol
stands where it does is decided by few words around it; the words that decide are its scope. A symbol
whose scope lies within a repeated passage therefore stands in every copy of the passage.

For every window of ``WINDOW`` words one symbol of highest round with its scope inside the window, that of the
greatest fingerprint, is the window's anchor. Equal windows have equal anchors, neighbouring
windows mostly share one, and a document has about a quarter as many anchors as words. Steps:

1. Each document's anchors, sorted over the cluster by range of (anchor, doc_id): those that another
   document has too are kept. A hot anchor is many rows and is split like any range. The rows of copies
   (below) then go, and what is left is sorted and thinned again.
2. Documents with shared anchors give their windows at these anchors, with 96-bit fingerprints of
   all 13 words; of each fingerprint the smallest doc_id counts. This verifies the repeats.
3. Words covered by a window that also starts in a document with a smaller doc_id are removed.

Documents whose words all equal those of a smaller doc_id are one whole repeat; they are decided by 128
bits of the SHA-256 of their words, which keeps large groups of copies out of steps 2 and 3.

Defined results: words are runs of other than white space, unchanged; null and empty texts have no
words; texts of fewer than 13 words keep them all; windows of documents with the same doc_id do not
remove each other; documents with a null doc_id are compared with none; repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd
from .common import cut, table

WINDOW = 13
#: Rounds of pairs; runs are named before the first. More rounds widen scopes beyond a window, fewer make them
#: so narrow that texts share them by chance.
ROUNDS = 3
#: Anchors are told apart by this many bits; two that collide only cost a vain comparison of windows.
ANCHOR_BITS = 48
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NOTHING = hashlib.sha256(b"").hexdigest()


class Symbols:
    """A level of recompression: names, words [start, end), scopes [low, high), and documents."""

    def __init__(self, name, start, end, low, high, doc):
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc


def _neighbours(s: Symbols, edge_low: np.ndarray, edge_high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(has left, has right, low scope of the left neighbour, high scope of the right one). A missing neighbour's
    scope lies outside the document, so no window holds it: elsewhere the passage may go on."""
    same = s.doc[1:] == s.doc[:-1]
    left, right = np.append(False, same), np.append(same, False)
    low = np.where(left, np.append(0, s.low[:-1]), edge_low[s.doc])
    high = np.where(right, np.append(s.high[1:], 0), edge_high[s.doc])
    return left, right, low, high


def name_runs(s: Symbols, edge_low: np.ndarray, edge_high: np.ndarray) -> Symbols:
    """A maximal run of a symbol becomes one symbol, named by the symbol and its count. Its neighbours decide
    where it ends."""
    left, _, low, high = _neighbours(s, edge_low, edge_high)
    new = ~left
    new[1:] |= s.name[1:] != s.name[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(new)) - 1
    count = (last - begin + 1).astype(np.uint64)
    name = np.where(count > 1, wd.mixed(s.name[begin] + count * np.uint64(0xA24BAED4963EE407)), s.name[begin])
    return Symbols(name, s.start[begin], s.end[last], np.minimum(low[begin], s.low[begin]), np.maximum(high[last], s.high[last]), s.doc[begin])


def name_pairs(s: Symbols, edge_low: np.ndarray, edge_high: np.ndarray, turn: int) -> Symbols:
    """Left symbols followed by right ones become pairs. A left symbol stays single if its right neighbour
    is left too, a right one if its left neighbour is right."""
    left, right, low, high = _neighbours(s, edge_low, edge_high)
    is_right = (wd.mixed(s.name + np.uint64(0x8EBC6AF09C88C6E3 + turn)) >> np.uint64(63)).astype(bool)
    first = np.zeros(len(is_right), bool)
    first[:-1] = right[:-1] & ~is_right[:-1] & is_right[1:]
    second = np.append(False, first[:-1])
    single = ~first & ~second
    own_low = np.where(single & is_right, np.minimum(s.low, low), s.low)
    own_high = np.where(single & ~is_right, np.maximum(s.high, high), s.high)
    at = np.flatnonzero(~second)
    other = np.minimum(at + 1, len(is_right) - 1)
    pair = first[at]
    name = np.where(pair, wd.mixed(s.name[at] * np.uint64(0x9E3779B97F4A7C15) + s.name[other] + np.uint64(turn)), s.name[at])
    return Symbols(name, s.start[at], np.where(pair, s.end[other], s.end[at]), np.where(pair, np.minimum(s.low[at], s.low[other]), own_low[at]),
                   np.where(pair, np.maximum(s.high[at], s.high[other]), own_high[at]), s.doc[at])


def anchors(w: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of every window of the documents."""
    n = len(w.hashes)
    at = np.arange(n)
    starts = at[at + WINDOW <= np.repeat(w.first[1:], np.diff(w.first))] if n else at
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    edge_low, edge_high = w.first[:-1] - 1, w.first[1:] + 1
    s = Symbols(w.hashes, at, at + 1, at, at + 1, w.doc_of())
    sums = wd.prefix_sums(w.hashes)
    best = np.zeros((WINDOW, n + 1), np.uint64)  # [scope's length - 1][scope's low]
    flat = best.reshape(-1)  # one index is many times faster than two
    for level in range(ROUNDS + 1):
        if level == 1:
            s = name_runs(s, edge_low, edge_high)
        if level:
            s = name_pairs(s, edge_low, edge_high, level)
        size = s.high - s.low
        fits = np.flatnonzero((s.low >= 0) & (s.high <= n) & (size <= WINDOW))
        low, size = s.low[fits], size[fits]
        # told apart by all words of the scope; a higher round is a higher number
        key = wd.mixed(wd.between(sums, low, low + size) + s.name[fits]) >> np.uint64(2) | np.uint64(level << 62)
        np.maximum.at(flat, (size - 1) * (n + 1) + low, key)
    inside = best[0]
    for size in range(1, WINDOW):  # greatest of all scopes within [i, i + size]
        inside = np.maximum(np.maximum(inside, np.append(inside[1:], np.uint64(0))), best[size])
    return starts, inside[starts] >> np.uint64(64 - ANCHOR_BITS)


def fingerprints(w: wd.Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for each window."""
    one, two = (wd.mixed(wd.spans(w.hashes, starts, starts + WINDOW, base | 1) + np.uint64(k)) for k, base in enumerate(_BASES))
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: number of words, the SHA-256 of the words joined by spaces, and its first 128 bits as two numbers."""
    for b in batches:
        for low, high, text in wd.slices(b.column(2)):
            w = wd.words(text)
            joined = [hashlib.sha256(b" ".join(text.doc(d).split())).digest() for d in range(high - low)]
            prints = np.frombuffer(b"".join(joined), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), pa.array(np.diff(w.first)),
                                              pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([x.hex() for x in joined], pa.string())],
                                             ["doc_id", "tag", "n_words", "h1", "h2", "sha"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for low, _, text in wd.slices(b.column(1)):
            w = wd.words(text)
            starts, anchor = anchors(w)
            doc = w.doc_of()[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(ids[low + doc[new]], pa.int64())], ["anchor", "doc_id"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, doc_id): those whose anchor has more than one document. The first and last
    anchor of a batch may go on in its neighbours and are kept."""
    for b in batches:
        anchor, doc = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(anchor):
            continue
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(begin, len(anchor)))
        shared = doc[begin] != doc[begin + size - 1]
        shared[0] = shared[-1] = True
        keep = np.repeat(shared, size)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(doc[keep])], ["anchor", "doc_id"])


def _runs(places: np.ndarray) -> bytes:
    """Sorted distinct places as (begin, end) of runs, 32 bits each."""
    begin = np.flatnonzero(np.append(True, np.diff(places) > 1)) if len(places) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(places)) - 1
    return np.column_stack([places[begin], places[end] + 1]).astype(np.int32).tobytes()


def _places(runs: bytes) -> np.ndarray:
    begin, end = np.frombuffer(runs, np.int32).reshape(-1, 2).T
    n = end - begin
    return (np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)).astype(np.int32)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the starts of their windows whose anchors are shared."""
    for b in batches:
        shared = b.column(3)
        for low, high, text in wd.slices(b.column(2)):
            w = wd.words(text)
            starts, anchor = anchors(w)
            edges = np.searchsorted(starts, w.first)
            found = []
            for d in range(high - low):
                own = slice(edges[d], edges[d + 1])
                hit = np.isin(anchor[own].view(np.int64), shared[low + d].values.to_numpy(zero_copy_only=False))
                found.append(_runs(starts[own][hit] - w.first[d]))
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(low, high - low) for k in range(3)), pa.array(found, pa.binary())],
                                             ["doc_id", "tag", "text", "starts"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, found = b.column(0).to_numpy(), b.column(2)
        for low, high, text in wd.slices(b.column(1)):
            w = wd.words(text)
            own = [_places(found[low + d].as_py()) for d in range(high - low)]
            doc = np.repeat(np.arange(high - low), [len(x) for x in own])
            place = np.concatenate(own)
            one, two = fingerprints(w, w.first[doc] + place)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(ids[low + doc]), pa.array(place)], ["w1", "w2", "doc_id", "place"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the starts of their repeated windows, (place, w2), to what is left of them. Windows of
    another text with the same doc_id are told by w2."""
    for b in batches:
        places = b.column(3)
        for low, high, text in wd.slices(b.column(2)):
            w = wd.words(text)
            pairs = [places[low + d].values.flatten() for d in range(high - low)]
            doc = np.repeat(np.arange(high - low), [len(x[0]) for x in pairs])
            at, two = (np.concatenate([x[k].to_numpy() for x in pairs]) for k in (0, 1))
            at = w.first[doc] + at
            inside = at + WINDOW <= w.first[doc + 1]
            doc, at, two = doc[inside], at[inside], two[inside]
            hit = fingerprints(w, at)[1] == two
            doc, at = doc[hit], at[hit]
            edge = np.searchsorted(doc, np.arange(high - low + 1))
            counts, hashes = [], []
            for d in range(high - low):
                n = int(w.first[d + 1] - w.first[d])
                place = np.unique(at[edge[d]:edge[d + 1]]) - w.first[d]
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, place, 1)
                np.add.at(edges, place + WINDOW, -1)
                covered = np.cumsum(edges[:-1]) > 0
                counts.append(int(covered.sum()))
                hashes.append(hashlib.sha256(b" ".join(x for x, gone in zip(text.doc(d).split(), covered.tolist()) if not gone)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), b.column(1).slice(low, high - low),
                                              pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "tag", "n_removed", "kept_sha256"])


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (anchor, doc_id) whose anchor has several documents, and few others."""
    return (rows.select("anchor", "doc_id").repartitionByRange("anchor", "doc_id").sortWithinPartitions("anchor", "doc_id")
            .mapInArrow(_shared_rows, "anchor long, doc_id long"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_removed, kept_sha256, one row per row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tagged = texts.select("doc_id", F.xxhash64("text").alias("tag"), "text")  # the tag tells apart rows that share an id
    whole = cut(tagged.mapInArrow(_whole, "doc_id long, tag long, n_words long, h1 long, h2 long, sha string"), "whole")
    # cut, so that a large group of copies can be split in the join below
    first = cut(whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "first")
    copies = cut(whole.filter(F.col("n_words") >= WINDOW).join(first, ["h1", "h2"]).filter("doc_id > first_id").select("doc_id", "tag").distinct(), "copies")

    # 1: shared anchors, by document, without the documents whose every row is a copy
    rest = whole.join(copies, ["doc_id", "tag"], "left_anti").select("doc_id")
    only_copies = copies.select("doc_id").distinct().join(rest, "doc_id", "left_anti")
    # a range exchange reads its input twice, for the bounds and for the rows; both inputs are cut, so that each is computed once
    rows = cut(texts.filter("doc_id IS NOT NULL").mapInArrow(_anchor_rows, "anchor long, doc_id long"), "anchors")
    shared = _shared(cut(_shared(rows).join(only_copies, "doc_id", "left_anti"), "shared"))
    by_doc = shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    # 2: their windows, verified
    found = cut(tagged.join(by_doc, "doc_id").mapInArrow(_candidates, "doc_id long, tag long, text string, starts binary")
                .filter("octet_length(starts) > 0"), "candidates")
    windows = found.select("doc_id", "text", "starts").mapInArrow(_windows, "w1 long, w2 int, doc_id long, place int")
    # cut, so that both sides of the join below are exchanged and a hot window can be split at run time
    repeats = cut(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
                  .filter("first_id < last_id").select("w1", "w2", "first_id"), "repeats")
    places = (windows.join(repeats, ["w1", "w2"]).filter("doc_id > first_id")
              .groupBy("doc_id").agg(F.collect_list(F.struct("place", "w2")).alias("places")))

    # 3: what is left
    left = (found.select("doc_id", "tag", "text").join(places, "doc_id")
            .mapInArrow(_removed, "doc_id long, tag long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "tag"]))
    gone = copies.withColumn("copy", F.lit(True))
    return (whole.join(left, ["doc_id", "tag"], "left").join(gone, ["doc_id", "tag"], "left")
            .select("doc_id", "n_words",
                    F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(F.col("copy"), F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM g),
f AS (SELECT x, min(doc_id) AS first_id FROM h GROUP BY x HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM h JOIN f USING (x) WHERE doc_id > first_id),
c AS (SELECT doc_id, list(j) AS js FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(js, k)], ' '), '') END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
