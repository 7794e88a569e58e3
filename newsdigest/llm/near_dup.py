"""Near-duplicate documents by Order MinHash.

A document is its sequence of shingles of five words. Shingles are labelled with their occurrence
in the document, so repeats are different; for each of ``SKETCHES`` orders the ``KEEP`` smallest
labelled shingles are taken and put back into text order, and their hash is a key. Documents that
share a key are candidates: their shingles agree, and in their order, which follows the edit
similarity. Candidates are verified by banded alignment: with M shingles aligned, of n1 and n2,
the similarity is M / (n1 + n2 - M), the Jaccard index of ordered shingles; 0.8 links.

Documents with equal words are one node. In a first step each node of a bucket is compared with
the bucket's smallest and largest; linked nodes form components. Buckets whose other nodes fall into
several components are left with pairs that were not compared. There each node outside the bucket's main
component meets, in blocks, the nodes of similar length that are not of its own component: a block
bounds all its similarities at once by the shingles in common, aligns what can still be similar, and
passes over nodes that it has already linked. It gives only links, fewer than its nodes. A pair with several keys is left to the first of
them. So no bucket is expanded into pairs outside a task, and no link between candidates is lost. A
pair of long texts at the similarity shares none of the keys with a chance of 1e-5, one of 8 and 9 words with 3e-4;
more similar pairs, less.

Defined results: words are runs of other than white space, A-Z lower-cased; a text of fewer than five
words is one shingle; a null, empty or blank text has none and is a class of its own; of each class
the smallest doc_id stays; repeated rows are copies of each other; an empty table gives an empty
result. Of classes without an id one text stays, too. Nodes are 64 bits of a digest of all words; texts
that only agree in these 64 of 128 bits become nodes of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd
from .alignment import banded_common
from .common import cut, table
from .components import components
from .vectors import renewed

SHINGLE, SIMILAR = 5, 0.8
#: Orders, and labelled shingles kept of each.
SKETCHES, KEEP = 16, 3
#: Nodes, and bytes of their words, of a block in which components of a bucket are compared, on average.
BLOCK, BLOCK_BYTES = 512, 16 << 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(1905)
_XOR = _rng.integers(0, 1 << 63, SKETCHES, np.uint64)
_TIMES = _rng.integers(0, 1 << 63, (SKETCHES, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of documents, in order, and where each document's begin; a document of one to
    four words has one shingle."""
    n = np.diff(first)
    starts, found = wd.grams(hashes, first, SHINGLE)
    count = np.maximum(n - SHINGLE + 1, 0)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = wd.mixed(wd.spans(hashes, first[short], first[short + 1]) + n[short].astype(np.uint64))
        count[short] = 1
        found = np.insert(found, np.searchsorted(starts, first[short]), whole)
    return found, np.concatenate([[0], np.cumsum(count)])


def labelled(found: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the occurrence of the shingle in its document."""
    own = wd.mixed(found + doc_of.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    begins = np.flatnonzero(new)
    occurrence = np.empty(len(own), np.uint64)
    occurrence[order] = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
    return wd.mixed(found + occurrence * np.uint64(0x9FB21C651E98DF25))


def sketches(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SKETCHES keys for each document that has shingles (``first`` skips the others)."""
    n = np.diff(first)
    docs = len(n)
    doc_of = np.repeat(np.arange(docs), n)
    own = labelled(found, doc_of)
    keys = np.empty((docs, SKETCHES), np.int64)
    for j in range(SKETCHES):
        order = (own ^ _XOR[j]) * _TIMES[j, 0]
        order ^= order >> np.uint64(32)
        order *= _TIMES[j, 1]
        # places of the smallest, one after another; a document with fewer shingles runs out
        places = np.full((KEEP, docs), len(own))
        for k in range(KEEP):
            least = np.minimum.reduceat(order, first[:-1])
            at = np.flatnonzero(order == np.repeat(least, n))
            at = at[order[at] != _TOP]
            places[k, doc_of[at[::-1]]] = at[::-1]
            order[at] = _TOP
        places.sort(axis=0)
        key = np.full(docs, j + 1, np.uint64)
        for k in range(KEEP):
            there = places[k] < len(own)
            key[there] = wd.mixed(key[there] * np.uint64(0x9E3779B97F4A7C15) + own[places[k, there]])
        keys[:, j] = key.view(np.int64)
    return keys


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high, text in wd.slices(b.column(2)):
            w = wd.words(text, mapped=wd.LOWER)
            found, first = shingles(w.hashes, w.first)
            n = np.diff(first)
            whole = b"".join(hashlib.blake2b(b" ".join(text.doc(d).lower().split()), digest_size=16).digest() for d in range(high - low))
            node, other = np.frombuffer(whole, np.int64).reshape(-1, 2).T
            full = np.flatnonzero(n)
            sizes = np.zeros(high - low, np.int64)
            sizes[full] = SKETCHES
            keys = sketches(found, np.append(first[full], len(found))).ravel() if len(full) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), pa.array(node),
                                              pa.array(other), pa.array(n), lists], ["doc_id", "tag", "node", "other", "n", "keys"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Low halves of the word hashes of a text: shingles of five of them tell texts apart."""
    for b in batches:
        for low, high, text in wd.slices(b.column(1)):
            w = wd.words(text, mapped=wd.LOWER)
            half = (w.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low),
                                              pa.array([half[w.first[d]:w.first[d + 1]].tobytes() for d in range(high - low)], pa.binary())],
                                             ["node", "words"])


def _shingles_of(words: bytes) -> np.ndarray:
    hashes = wd.mixed(np.frombuffer(words, np.uint32).astype(np.uint64) + np.uint64(1))
    return shingles(hashes, np.array([0, len(hashes)]))[0]


def is_similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Banded alignment of two shingle sequences. M / (n1 + n2 - M) >= s needs M >= s (n1 + n2) / (1 + s),
    so at most (n1 + n2) (1 - s) / (1 + s) shingles are unaligned, which bounds the band."""
    n = len(a) + len(b)
    need = least * n / (1 + least) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need:  # cannot align, whatever the order
        return False
    return banded_common(a.tolist(), b.tolist(), int(n * (1 - least) / (1 + least)) + 1) >= need


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([is_similar(_shingles_of(x), _shingles_of(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar."""
    left = sequences.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = sequences.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", _similar.asNondeterministic()("wa", "wb").alias("similar")).filter("similar").select("a", "b"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of buckets whose nodes, other than those that all were compared with, fall into
    several components."""
    rest = (members.filter("node <> low AND node <> high").select("key", "node").join(roots, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    keys = cut(rest.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key"), "mixed")
    return cut(rest.join(keys, "key"), "mixed")


def _parts(table: pa.Table) -> tuple:
    """(nodes, roots, keys, sizes, shingles, labels of the shingles) of the rows of a block."""
    found = [_shingles_of(x) for x in table.column("words").to_pylist()]
    labels = [labelled(x, np.zeros(len(x), np.int64)) for x in found]
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(found), SKETCHES)
    return *(table.column(c).to_numpy() for c in ("node", "root")), keys, np.array([len(x) for x in found]), found, labels


def _in_common(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Number of labels that each of a shares with each of b: products of the tables of which row has which label."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    places = []
    for x in (a, b):
        row, label = np.repeat(np.arange(len(x)), [len(y) for y in x]), np.concatenate(x)
        at = np.minimum(np.searchsorted(both, label), max(len(both) - 1, 0))
        hit = both[at] == label if len(both) else np.zeros(len(label), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], row[hit][order]))
    total = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(both), columns):
        tables = []
        for x, (at, row) in zip((a, b), places):
            own = slice(*np.searchsorted(at, [low, low + columns]))
            has = np.zeros((len(x), min(columns, len(both) - low)), np.float32)
            has[row[own], at[own] - low] = 1
            tables.append(has)
        total += tables[0] @ tables[1].T
    return total


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) that join the components of two blocks of a bucket, at most one fewer than there are components. On the
    right is no node of the bucket's main component."""
    links: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        order, main = left.column("order")[0].as_py(), left.column("main")[0].as_py()
        rows, row_roots, row_keys, row_sizes, row_shingles, row_labels = _parts(left)
        asked, roots, keys, sizes, found, labels = _parts(right)
        # of two nodes outside the main component, the smaller asks
        open_pairs = (roots[:, None] != row_roots) & ((row_roots == main) | (asked[:, None] < rows))
        for j in range(order):  # compared where they share an earlier key
            open_pairs &= keys[:, j, None] != row_keys[:, j]
        common = _in_common(labels, row_labels)
        open_pairs &= common >= SIMILAR * (sizes[:, None] + row_sizes) / (1 + SIMILAR) - 1e-6
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        pairs = np.argwhere(open_pairs)
        for i, j in pairs[np.argsort(-common[open_pairs], kind="stable")].tolist():
            a, b = top(int(roots[i])), top(int(row_roots[j]))
            if a != b and is_similar(found[i], row_shingles[j]):
                up[max(a, b)] = min(a, b)
                links.append((int(asked[i]), int(rows[j])))
    a, b = (pa.array([x[k] for x in links], pa.int64()) for k in range(2))
    return pa.table([a, b], ["a", "b"])


def _left_links(mixed: DataFrame, nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Links between nodes of different components of a mixed bucket. Similar nodes differ in length by SIMILAR at most, so
    lengths are cut into classes in that ratio, and a node asks those of its own class and of its neighbours."""
    step = F.floor(F.log("n") / np.log(1 / SIMILAR) + 1e-9).cast("int")
    about = cut(sequences.select("node", F.octet_length("words").alias("bytes")).join(nodes.select("node", "n", "keys"), "node"), "open-nodes")
    own = cut(mixed.join(about, "node").select(
        "key", "node", "root", "bytes", "keys", step.alias("step"), (F.array_position("keys", F.col("key")) - 1).cast("int").alias("order")), "open-nodes")
    mains = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    own = cut(own.join(mains, "key"), "open-nodes")
    asking = own.filter("root <> main").withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    at = ["key", "step"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES))
        return rows.groupBy(*at).agg(n.cast("int").alias(name))

    grid = cut(blocks(own, "down").join(blocks(asking, "across"), at), "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    left = own.join(grid, at).withColumn("v", one("down", 1)).withColumn("q", every("across"))
    right = asking.join(grid, at).withColumn("q", one("across", 2)).withColumn("v", every("down"))
    sides = [renewed(x.join(sequences, "node").select(*at, "v", "q", "node", "root", "main", "order", "keys", "words")) for x in (left, right)]
    by = [*at, "v", "q"]
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(_compared, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, class_id (the smallest doc_id of its class), class_size (rows), kept,
    and tag (a checksum of the text that tells apart rows that share an id), one row per row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tag = F.xxhash64("text").alias("tag")
    rows = cut(texts.select("doc_id", tag, "text").mapInArrow(_sketched, "doc_id long, tag long, node long, other long, n long, keys array<long>"), "sketches")
    clashes = cut(rows.groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least <> most").select("node", "least"), "clashes")
    if not clashes.isEmpty():
        own = F.when(F.col("least") < F.col("other"), F.xxhash64("node", "other")).otherwise(F.col("node"))
        rows = cut(rows.join(clashes, "node", "left").withColumn("node", own).drop("least"), "sketches")
    # the smallest id, a null one last
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    nodes = cut(rows.filter("n > 0").groupBy("node").agg(F.min(place).alias("rep"), F.first("keys").alias("keys"), F.first("n").alias("n")), "nodes")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    members = cut(bands.join(shared, "key"), "members")
    ends = F.explode(F.array("low", "high"))
    pairs = members.select(F.col("node").alias("a"), ends.alias("b")).filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tag").alias("rep_tag"))
    sequences = cut(texts.withColumn("tag", F.xxhash64("text"))
                    .join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("tag") == F.col("rep_tag")))
                    .select("node", "text").mapInArrow(_sequences, "node long, words binary").dropDuplicates(["node"]), "sequences")
    links = cut(_verified(pairs, sequences), "links")
    roots = components(links)
    mixed = _mixed(members, roots)
    if not mixed.isEmpty():
        more = cut(_left_links(mixed, nodes, sequences), "links")
        if not more.isEmpty():  # the components so far, and the links between them
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    own = rows.select("doc_id", "tag", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = cut(own.filter("n > 0").groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("class_size"))
             .select("root", F.col("first.doc_id").alias("class_id"), F.col("first.tag").alias("class_tag"), "class_size"), "classes")
    is_first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tag") == F.col("class_tag"))
    full = own.filter("n > 0").join(of, "root").select("doc_id", "class_id", "class_size", "tag", is_first.alias("kept"))
    alone = rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "tag", F.lit(True).alias("kept"))
    return full.unionByName(alone)


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of docs that stays of each class, with docs' own columns. Of rows that repeat an id and
    its text one stays."""
    kept = classes(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag")).distinct()
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return (own.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tag") == F.col("kept_tag")))
            .dropDuplicates(["doc_id", "tag"]).select("row.*"))
