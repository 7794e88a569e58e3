"""Session helpers: building a local session for tests/bench, the checkpoint folder,
and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "newsdigest") -> SparkSession:
    """A session for tests and the bench. On a cluster, use the cluster's session."""
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. A cluster names a shared folder in
    ``spark.checkpoint.dir``; only when it is unset and the master is local (tests) a fresh
    temp folder is set. On a cluster that would be a folder of one machine, so it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not (sc.master or "").startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="newsdigest-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_SHIPPED: set = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``newsdigest`` importable in the Python workers (mapInPandas / pandas UDF
    bodies refer to its modules): the package is zipped once per application on the
    driver and added with ``addPyFile``, which distributes it to every executor."""
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext API (remote session): nothing to ship
        return
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        import zipfile
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        out = os.path.join(tempfile.mkdtemp(prefix="newsdigest-pkg-"), "newsdigest.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, root))
        try:
            sc.addPyFile(out)
        except Exception:  # noqa: BLE001 - already registered by an earlier call
            pass
        _SHIPPED.add(key)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_parquet(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back: later reads take only the
    columns they need, and a lost executor costs nothing that was written."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cluster's cores before CPU-heavy per-row work (text cleaning,
    HTML parsing) when the scan yields fewer partitions than cores (a file with one row
    group is one task). On a large input the scan already has enough partitions and this
    is a no-op, so no shuffle is added there."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD API (e.g. a remote session): leave the plan as is
        return df
    return df.repartition(cores) if n < cores else df


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    for t in _TABLES:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(t)
