"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's direction is turned by a random rotation into ``BITS_PER_DIM`` times as many dimensions, and of
each coordinate only the sign is kept. The signs, as a unit vector, have an inner product with the
direction that is stored with them; divided by it, the inner product of the signs with a query's rotated
direction is an unbiased estimate of the cosine, and its error is that of a random direction in so many
dimensions: ``SIGMAS`` standard errors bound it. A query's coordinates are rounded to ``PLANES`` bits, so that the
estimate is a sum of bit counts of the packed code with the query's bit planes.

``build`` writes the index: every vector with its code and correction. ``search`` lets blocks of the index
and of queries meet in cells (see ``vectors``): of each query the most promising codes are ranked by the vectors
themselves, which gives the cosine to beat; every vector whose estimate plus bound reaches it is then
reranked. So only the bound can miss a neighbour, and no list of candidates leaves the cell.

Defined results: rows without an id or a vector, vectors of zeros only, and those with a null or non-finite
component take no part; a vector of fewer components ends in zeros; rows that repeat id and vector count once; rows
with a query's id are no neighbours of it; ties go to the smaller id; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, table
from .vectors import in_cells, is_finite, matrix

#: Bits of a code for each dimension of the vectors, standard errors that bound an estimate, bits of a query's coordinate.
BITS_PER_DIM, SIGMAS, PLANES = 4, 3.0, 6
NEIGHBOURS = 5
#: Codes ranked by their vectors before the bound is set, for each neighbour wanted.
FIRST = 4


def rotation(dims: int, bits: int, seed: int = 1212) -> np.ndarray:
    """(bits, dims): orthonormal columns in a random direction."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each (exactly), so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated rows, and the inner products of the rows' directions with them."""
    turned = scaled(x) @ turn.T
    bits = turned > 0
    inner = np.abs(turned).sum(axis=1) / (_length(scaled(x)) * np.sqrt(len(turn)))
    return np.packbits(bits, axis=1, bitorder="little"), inner


class Query:
    """A query's rotated direction in bit planes."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.bits = len(turn)
        direction = turn @ (x / np.sqrt((x * x).sum()))
        self.low = float(direction.min())
        self.step = max(float(direction.max()) - self.low, 1e-12) / ((1 << PLANES) - 1)
        levels = np.rint((direction - self.low) / self.step).astype(np.uint8)
        self.total = self.low * self.bits + self.step * float(levels.sum())
        self.planes = [np.packbits(levels >> j & 1, bitorder="little").view(np.uint64) for j in range(PLANES)]

    def estimates(self, codes: np.ndarray, ones: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines with the codes (words, rows) of ``ones`` set bits each, and their bounds of error."""
        counts = np.zeros(codes.shape[1], np.int64)
        for j, plane in enumerate(self.planes):
            for word, mask in zip(codes, plane):
                counts += np.bitwise_count(word & mask).astype(np.int64) << j
        product = (2 * (self.low * ones + self.step * counts) - self.total) / np.sqrt(self.bits)
        # of the code, and of rounding the query's coordinates
        spread = (1 - np.minimum(inner * inner, 1)) / max(self.bits - 1, 1) + self.step ** 2 / 12
        return product / inner, SIGMAS * np.sqrt(spread) / inner


def build(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """embeddings (vec_id, embedding) to the index (vec_id, vector, code, inner), a written table, and its dimensions."""
    vector = F.col("embedding")
    rows = cut(embeddings.filter(F.col("vec_id").isNotNull() & is_finite(vector) & ((F.array_max(vector) != 0) | (F.array_min(vector) != 0)))
               .select("vec_id", vector.alias("vector")).dropDuplicates(), "vectors")
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    turn = rotation(dims, -(-dims * BITS_PER_DIM // 64) * 64)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, inner = encode(matrix(b.column(1), dims), turn)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(inner)],
                                             ["vec_id", "vector", "code", "inner"])

    kind = rows.schema["vector"].dataType.simpleString()
    return cut(rows.mapInArrow(codes, f"vec_id long, vector {kind}, code binary, inner double"), "codes"), dims


def search(index: DataFrame, dims: int, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest rows of the index for each query (vec_id, vector): query_id, rank, vec_id, score."""
    turn = rotation(dims, -(-dims * BITS_PER_DIM // 64) * 64)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id")
        ids, inner = left.column("vec_id").to_numpy(), left.column("inner").to_numpy()
        x = scaled(matrix(left.column("vector"), dims))
        codes = np.ascontiguousarray(np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint64).reshape(len(ids), len(turn) // 64).T)
        ones = np.bitwise_count(codes).sum(axis=0, dtype=np.int64)
        length, found = _length(x), []
        for i, (own, y) in enumerate(zip(right.column("vec_id").to_pylist(), scaled(matrix(right.column("vector"), dims)))):
            # the sum of a row does not depend on the rows beside it
            cosines = lambda at: (x[at] * y).sum(axis=1) / (length[at] * np.sqrt((y * y).sum()))  # noqa: B023, E731
            near, error = Query(y, turn).estimates(codes, ones, inner)
            near[ids == own] = -np.inf
            others = np.flatnonzero(ids != own)
            if len(others) > FIRST * k:
                first = np.argpartition(-near, FIRST * k)[:FIRST * k]
                first = first[ids[first] != own]
                least = np.partition(cosines(first), len(first) - k)[len(first) - k]
                others = np.flatnonzero(near + error >= least)
            score = cosines(others)
            best = np.lexsort((others, -score))[:k]
            found.append((np.full(len(best), i), ids[others[best]], score[best]))
        place, other, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        columns = [pa.array(right.column(c).to_numpy()[place], pa.int64()) for c in ("vec_id", "twin")]
        return pa.table([*columns, pa.array(other, pa.int64()), pa.array(score, pa.float64())], ["query_id", "twin", "vec_id", "score"])

    # twin tells apart queries that share an id
    asked = queries.select("vec_id", "vector", F.xxhash64("vector").alias("twin"))
    sizes = index.count(), asked.count()
    out = in_cells(index, asked, *sizes, ["vec_id", "vector"], cell, "query_id long, twin long, vec_id long, score double")
    best = W.Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, dims = build(table(spark, sf_dir, "embeddings"))
    return search(index, dims, index.filter("vec_id % 50 = 0"))


#: Exact neighbours. The bound may miss one by chance; on the tables of the tests it misses none.
OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
