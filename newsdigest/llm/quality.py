"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a vector of ``DIM`` hashed words (logarithms of counts, scaled to unit length),
statistics of its structure, and its metadata (declared length). The machine adds a weight for
each feature and, for each pair, the product of two low-rank factors; the pair sum is taken in
linear time as half of (sum of v x) squared less the sum of (v x) squared. It is fitted on a
bounded sample of labelled rows, and every whole text is scored in its Spark task.

Defined results: null counts as empty text; empty texts get the score of their (empty)
structure; a missing or null declared length counts as the text's own length; null labels are ignored, of
several labels of a document the largest counts; without labelled rows of both kinds every score is the
same. Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd
from .common import table

#: Documented bound of the fit: it sees this many labelled rows at most, drawn by a hash of doc_id.
MAX_TRAIN = 6000
#: Hashed word features; rank of the pair factors.
DIM, RANK = 1024, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 0.02, 1e-4, 11

_CLASSES = [wd.byte_class(x) for x in (
    range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), [0x20], [0x0A], b"|", b"!", b".,;:?", b"%&#$*@^~+=_<>/\\`",
    b"()[]{}\"'-", range(0x80, 0x100))]
#: Structure statistics after the byte classes: see ``_structure``.
N_STATS = len(_CLASSES) + 8
WIDTH = DIM + N_STATS


def _structure(text: wd.Text, w: wd.Words, counts: np.ndarray, declared: np.ndarray) -> np.ndarray:
    docs = len(text.offsets) - 1
    n_bytes = np.diff(text.offsets)
    doc_of_byte = np.repeat(np.arange(docs), n_bytes)
    histogram = np.bincount(doc_of_byte * 256 + text.data, minlength=docs * 256).reshape(docs, 256)
    classes = histogram @ np.stack(_CLASSES).T.astype(np.int64)
    n = np.diff(w.first)
    some, doc_of = np.maximum(n, 1), w.doc_of()
    by_doc = lambda x: np.bincount(doc_of, weights=x, minlength=docs) / some
    size = (w.ends - w.starts).astype(float)
    same_as_last = np.zeros(len(size))
    same_as_last[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc_of[1:] == doc_of[:-1])
    last = text.data[w.ends - 1] if len(size) else np.zeros(0, np.uint8)
    plain_end = wd.ALNUM[last]
    mean = by_doc(size)
    chars = n_bytes - histogram[:, 0x80:0xC0].sum(axis=1)  # UTF-8 continuation bytes are no characters
    declared = np.where(np.isnan(declared), chars, declared)
    return np.column_stack([
        classes / np.maximum(n_bytes, 1)[:, None],
        np.log1p(n), mean / 10, np.sqrt(np.maximum(by_doc(size * size) - mean * mean, 0)) / 10, by_doc(same_as_last),
        by_doc((~plain_end).astype(float)), (counts > 0).sum(axis=1) / np.minimum(some, DIM), by_doc((size > 20).astype(float)),
        np.log1p(np.maximum(declared, 0)),  # metadata
    ])


def features(texts: pa.Array, declared: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of WIDTH features, a slice of documents at a time."""
    for low, high, text in wd.slices(texts, 1 << 19):
        w = wd.words(text, mapped=wd.LOWER)
        docs = high - low
        place = w.doc_of() * DIM + (w.hashes % np.uint64(DIM)).astype(np.int64)
        counts = np.bincount(place, minlength=docs * DIM).reshape(docs, DIM)
        hashed = np.log1p(counts)
        hashed /= np.maximum(np.sqrt((hashed * hashed).sum(axis=1)), 1e-9)[:, None]
        yield np.hstack([hashed, _structure(text, w, counts, declared[low:high])]).astype(np.float32)


class FactorisationMachine:
    """bias, weights and pair factors over standardised features."""

    def __init__(self, mean, scale, bias, weight, factor):
        self.mean, self.scale, self.bias, self.weight, self.factor = mean, scale, bias, weight, factor

    @staticmethod
    def pairs(x: np.ndarray, factor: np.ndarray) -> np.ndarray:
        s = x @ factor
        return 0.5 * ((s * s).sum(axis=1) - (x * x) @ (factor * factor).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weight + self.pairs(x, self.factor), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> FactorisationMachine:
        """Adam over shuffled batches of the logistic loss, with decay on weights and factors."""
        rng = np.random.default_rng(SEED)
        width = x.shape[1] if len(x) else WIDTH
        if len(set(y.tolist())) < 2:
            odds = 0.0 if not len(y) else (30.0 if y[0] else -30.0)
            return cls(np.float32(0), np.float32(1), odds, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32))
        mean, scale = x.mean(axis=0), x.std(axis=0)
        # hashed words keep their sparse scale; statistics are standardised
        mean[:DIM], scale[:DIM] = 0, 0.1
        scale = np.where(scale < 1e-6, 1, scale).astype(np.float32)
        x = np.clip((x - mean) / scale, -6, 6)
        rate = y.mean()
        params = {"b": np.array([np.log(rate / (1 - rate))]), "w": np.zeros(width, np.float32),
                  "v": rng.normal(0, 0.01, (width, RANK)).astype(np.float32)}
        first, second = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                xb, yb = x[order[at:at + BATCH]], y[order[at:at + BATCH]]
                step += 1
                s = xb @ params["v"]
                z = params["b"][0] + xb @ params["w"] + 0.5 * ((s * s).sum(axis=1) - (xb * xb) @ (params["v"] ** 2).sum(axis=1))
                e = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - yb).astype(np.float32) / len(xb)
                grads = {"b": np.array([e.sum()]), "w": xb.T @ e + DECAY * params["w"],
                         "v": xb.T @ (e[:, None] * s) - ((xb * xb).T @ e)[:, None] * params["v"] + DECAY * params["v"]}
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    params[k] -= RATE * (0.5 if epoch > EPOCHS * 2 // 3 else 1) * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return cls(mean.astype(np.float32), scale, float(params["b"][0]), params["w"], params["v"])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def _declared(docs: DataFrame) -> Column:
    if "n_chars" in docs.columns:
        return F.col("n_chars").cast("double")
    return F.lit(None).cast("double")


def _as_floats(declared: pa.Array) -> np.ndarray:
    return declared.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> FactorisationMachine:
    """Fit on at most ``most`` labelled documents that are not held out. Their ids (at most
    ``most``) are broadcast; their feature rows are computed in tasks and come to the driver."""
    ids = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
           .select(F.col("doc_id").alias("train_id"), F.col("quality").cast("double").alias("train_quality")))
    rows = docs.select("doc_id", "text", _declared(docs).alias("declared")).join(F.broadcast(ids), F.col("doc_id") == F.col("train_id"))

    def vectors(batches):
        for b in batches:
            at = 0
            for x in features(b.column(1), _as_floats(b.column(2))):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), b.column(3).slice(at, len(x)),
                                                  pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())],
                                                 ["doc_id", "y", "x"])
                at += len(x)

    found = sorted(rows.select("doc_id", "text", "declared", "train_quality").mapInArrow(vectors, "doc_id long, y double, x binary")
                   .limit(most).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float16) for r in found], np.float32).reshape(len(found), WIDTH)
    return FactorisationMachine.fit(x, np.array([r.y for r in found], np.float32))


def score_column(docs: DataFrame, model: FactorisationMachine) -> Column:
    """The score of each row's text. The model (some tens of kilobytes) travels with the task."""

    @F.arrow_udf("double")
    def score(texts: pa.Array, declared: pa.Array) -> pa.Array:
        found = [model.score(x) for x in features(texts, _as_floats(declared))]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score.asNondeterministic()(F.col("text"), _declared(docs))  # so a filter on it does not score twice


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with docs' own columns."""
    score = score_column(docs, train(docs, labels))
    return (docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), score.alias("score"))
            .filter("score >= 0.5").select("row.*"))
