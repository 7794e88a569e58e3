"""Hard negatives by exact integer products in a residue number system.

A vector's components become integers, floor(256 x). The matrix of rows and that of anchors are
reduced modulo several small primes; the residues, taken around zero, are multiplied as float32 matrices
(at most ``SPAN`` columns at a time, so that every sum stays below 2^24 and is exact), and the signed
score is put together by Chinese remaindering in balanced mixed radix. As many primes are taken as the
largest squared length asks for, since no score is larger than that. Rows meet anchors in cells (see
``vectors``), twice: first for each anchor's best rows of its own label, the positives; then each positive
opens a window of scores, and the best rows of other labels inside it are its hard negatives.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no
part; a vector of fewer components ends in zeros; rows that repeat id, label and vector count once; rows that
share an id and differ are rows of their own, but no positive of each other; ties go to the smaller id; an
anchor without another row of its label has no rows in the result, nor has a positive with a negative score
or without a row in its window; other columns are not looked at; an empty table gives an empty result.
Scores that could exceed 2^56 are an error, since the window could not be tested in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, table
from .vectors import in_cells, is_finite, matrix

#: Fixed values of the task: components times this, positives and negatives of an anchor, and the window's
#: lower and upper end in hundredths of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: The largest primes below 1024; their residues are at most 510 from zero.
PRIMES = [p for p in range(1023, 900, -1) if all(p % q for q in range(2, 32))]
SPAN = (1 << 24) // 510 ** 2
#: Anchors whose scores are held at once.
SLICE = 128


def primes_for(bound: int) -> list[int]:
    """As many primes as tell apart all integers from -bound to bound."""
    n, product = 0, 1
    while product <= 2 * bound:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:max(n, 1)]


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p around zero, as float32."""
    r = np.remainder(x, p)
    return (r - p * (r > p // 2)).astype(np.float32)


def _around_zero(x: np.ndarray, p: int) -> np.ndarray:
    x = np.remainder(x, np.int32(p))
    x -= np.int32(p) * (x > p // 2)
    return x


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed products of the rows of two integer matrices, given by their residues for each prime."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        left, right = a[k], b[k]
        r = np.zeros((len(left), len(right)), np.int32)
        for at in range(0, left.shape[1], SPAN):
            r += _around_zero((left[:, at:at + SPAN] @ right[:, at:at + SPAN].T).astype(np.int32), p)
        r = _around_zero(r, p)
        for q, digit in zip(primes, digits):  # the digits so far are taken off, one after another
            r = _around_zero((r - digit) * np.int32(pow(q, -1, p)), p)
        digits.append(r)
    score = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        score = score * p + digit
    return score


def _sides(rows: pa.Table, anchors: pa.Table, dims: int, primes: list[int]) -> tuple:
    """Rows in order of id, so that of equal scores the first is the one to take."""
    rows = rows.sort_by("vec_id")
    ints = [np.floor(SCALE * matrix(t.column("vector"), dims)).astype(np.int64) for t in (rows, anchors)]
    parts = [[residues(x, p) for p in primes] for x in ints]
    columns = [t.column(c).to_numpy() for t in (rows, anchors) for c in ("vec_id", "label")]
    return parts[0], parts[1], *columns


def _first(order: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of the places in ``order`` (ascending ids) the k of highest score, best first."""
    if len(order) > k:
        own = scores[order]
        least = np.partition(own, len(own) - k)[len(own) - k]
        above, equal = order[own > least], order[own == least]
        order = np.concatenate([above, equal[:k - len(above)]])
    return order[np.lexsort((order, -scores[order]))]


def positives(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], dims: int, primes: list[int], k: int) -> DataFrame:
    """(vec_id, twin, other, score, rank) of the k best other rows of each anchor's label."""
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        r, a, ids, labels, anchor_ids, anchor_labels = _sides(left, right, dims, primes)
        found: list[tuple] = []
        for value in np.unique(anchor_labels):
            here, there = np.flatnonzero(labels == value), np.flatnonzero(anchor_labels == value)
            for at in range(0, len(there), SLICE):
                mine = there[at:at + SLICE]
                for i, scores in zip(mine, products([x[mine] for x in a], [x[here] for x in r], primes)):
                    best = _first(np.flatnonzero(ids[here] != anchor_ids[i]), scores, k)
                    found.append((np.full(len(best), i), ids[here[best]], scores[best]))
        return _table(right, found, ["other", "score"])

    out = in_cells(rows, anchors, *sizes, ["vec_id", "label", "vector"], cell, "vec_id long, twin long, other long, score long")
    best = W.Window.partitionBy("vec_id", "twin").orderBy(F.desc("score"), "other")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _table(anchors: pa.Table, found: list[tuple], names: list[str]) -> pa.Table:
    """(place of the anchor, column, ...) of each anchor as a table."""
    columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [[]] * (1 + len(names)))]
    own = [anchors.column(c).to_numpy()[columns[0]] for c in ("vec_id", "twin")]
    return pa.table([pa.array(c, pa.int64()) for c in (*own, *columns[1:])], ["vec_id", "twin", *names])


def negatives(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], dims: int, primes: list[int], k: int, low: int, high: int) -> DataFrame:
    """(vec_id, twin, place, other, score, rank): the k best rows of another label in the window of each of an
    anchor's positives, whose scores are the column ``scores``."""
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        r, a, ids, labels, _, anchor_labels = _sides(left, right, dims, primes)
        wanted = right.column("scores").to_pylist()
        found: list[tuple] = []
        for at in range(0, len(wanted), SLICE):
            for i, scores in enumerate(products([x[at:at + SLICE] for x in a], r, primes), at):
                ends = [(-(-low * p // 100), high * p // 100) for p in wanted[i]]
                least, most = min(e[0] for e in ends), max(e[1] for e in ends)
                inside = np.flatnonzero((scores >= least) & (scores <= most) & (labels != anchor_labels[i]))
                inside = inside[np.argsort(-scores[inside], kind="stable")]
                ordered = -scores[inside]
                for place, (bottom, top) in enumerate(ends):
                    begin, end = np.searchsorted(ordered, [-top, -bottom + 1])
                    best = inside[begin:min(end, begin + k)]
                    found.append((np.full(len(best), i), np.full(len(best), place), ids[best], scores[best]))
        return _table(right, found, ["place", "other", "score"])

    out = in_cells(rows, anchors, *sizes, ["vec_id", "label", "vector"], cell, "vec_id long, twin long, place long, other long, score long")
    best = W.Window.partitionBy("vec_id", "twin", "place").orderBy(F.desc("score"), "other")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, is_anchor: Column, k_positives: int = POSITIVES, k_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """embeddings (vec_id, embedding, label) to anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; anchors are the rows where ``is_anchor`` holds. low * positive <= 100 * negative <= high * positive."""
    vector = F.col("embedding")
    rows = cut(embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(vector))
               .select("vec_id", F.col("label").cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
               .dropDuplicates(), "vectors")
    whole = F.aggregate("vector", F.lit(0.0), lambda t, x: t + F.pow(F.abs(x.cast("double")) * SCALE + 1, F.lit(2.0)))
    n, n_anchors, dims, longest = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.max(F.size("vector")), F.max(whole)).first()
    if (longest or 0) >= 1 << 56:
        raise ValueError(f"squared lengths reach {longest:g}: scores don't fit")
    primes = primes_for(int(longest or 0) + 1)
    sizes, dims = (n, n_anchors), dims or 0
    # twin tells apart anchors that share an id
    anchors = rows.filter("is_anchor").withColumn("twin", F.xxhash64("label", "vector")).drop("is_anchor")
    rows = rows.drop("is_anchor")
    best = cut(positives(rows, anchors, sizes, dims, primes, k_positives).filter("score >= 0"), "positives")
    # at most k_positives of each
    lists = (best.groupBy("vec_id", "twin").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))
             .select("vec_id", "twin", F.col("p.other").alias("others"), F.col("p.score").alias("scores")))
    asked = anchors.join(lists, ["vec_id", "twin"])
    found = negatives(rows, asked.drop("others"), sizes, dims, primes, k_negatives, low, high)
    at = (F.col("place") + 1).cast("int")
    return found.join(lists, ["vec_id", "twin"]).select(
        F.col("vec_id").alias("anchor_id"), F.element_at("others", at).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), F.element_at("scores", at).alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", turned), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
