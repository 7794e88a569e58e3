"""Small shared helpers: reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdigest.session import ensure_checkpoint_dir

#: Fixed value: the white space of the word and text contracts, as a Java and RE2 class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Repeated rows that one step numbers.
CHUNK = 4096


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``nth``, the number of a row among its equals. Equal rows are counted, and the count is dealt out again
    in chunks, so that no task numbers all of them, and the numbers don't depend on where rows are read."""
    of = rows.columns
    counted = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("rows"))
    chunks = counted.select(*of, "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))).alias("chunk"))
    once = chunks.filter("rows = 1").select(*of, F.lit(1).cast("long").alias("nth"))
    begin = F.col("chunk") * CHUNK
    more = chunks.filter("rows > 1").repartition(*of, "chunk").select(*of, F.explode(F.sequence(begin + 1, F.least(begin + CHUNK, "rows"))).alias("nth"))
    return once.unionByName(more)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back. The plan above starts
    from files that survive a lost executor, and reads only the columns it needs."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
