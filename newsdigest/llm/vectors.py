"""Vectors in cells: the rows of a table against a stated set of queries, block by block.

Rows and queries are dealt into blocks by a hash of their content, so a lost executor's blocks come out
alike; every block of rows meets every block of queries in one cell, which gives only its best rows of
each query. Neither side is broadcast or gathered, and a cell is as large whatever the table is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a cell, on average.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def is_finite(vector: Column) -> Column:
    """The vector is there and has no null, infinite or undefined component."""
    inf = F.lit(float("inf"))
    return (vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())
            & (F.coalesce(F.array_max(vector).cast("double"), F.lit(0.0)) < inf)
            & (F.coalesce(F.array_min(vector).cast("double"), F.lit(0.0)) > -inf))


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of float64; shorter ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a cogroup with a table of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def in_cells(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, by: list[str],
             cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``cell(rows, queries)`` of every block of rows and every block of queries; both have the columns ``by``,
    which deal them."""
    down, across = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    deal = lambda n: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    left = rows.withColumn("cell_row", deal(down)).withColumn("cell_query", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = queries.withColumn("cell_query", deal(across)).withColumn("cell_row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    at = ["cell_row", "cell_query"]
    right = renewed(right)
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(cell, schema)
