"""Session helpers: a local session for tests and bench, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
_local_roots: dict[str, str] = {}
_scopes: list[list[str]] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "weirflow") -> SparkSession:
    """Session for tests and bench; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for durable intermediates: what the cluster names in `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder, because there every task runs on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="weirflow-")
    return _local_roots[app]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end whatever was frozen inside: store or collect the results before."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for path in held:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freeze(df: DataFrame) -> DataFrame:
    """Write `df` once to the checkpoint folder and read it back.

    Cuts the lineage and pins values that a recomputed stage could otherwise change, such as partition ids.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/frozen-{uuid.uuid4().hex}"
    for held in _scopes:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan (the file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal out a frame of aggregated rows to all cores before CPU-heavy work: adaptive execution leaves it in one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def broadcast_if(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` when its proven bound of `rows` is small; otherwise Spark picks a shuffle join."""
    return F.broadcast(df) if rows <= limit else df
