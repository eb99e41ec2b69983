"""Flow records as comma-separated and as pipe-separated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.flowcols import idiv
from weirflow.schema import FIELDS, FLOW_SCHEMA, as_flows
from weirflow.session import broadcast_if, estimated_bytes, freeze

# Order of the pipe-separated fields; times are in milliseconds
PIPE_FIELDS = [
    "af", "first", "last", "prot", "sa0", "sa1", "sa2", "sa3", "sp", "da0", "da1", "da2", "da3", "dp",
    "srcas", "dstas", "inif", "outif", "tcp_flags", "tos", "packets", "octets",
]
PIPE_SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in PIPE_FIELDS])


def bytes_of(setting: str) -> int:
    """Bytes of a size setting such as 128MB or 134217728b."""
    digits = setting.lower().rstrip("bkmgt")
    unit = setting.lower()[len(digits):].rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def _read(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, sep: str, positions: bool, finish) -> DataFrame:
    inputs = [paths] if isinstance(paths, str) else list(paths)
    rows = None
    for i, path in enumerate(inputs):
        df = spark.read.schema(schema).csv(
            path, sep=sep, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
            mode="FAILFAST", recursiveFileLookup=True)
        if positions:
            df = df.select("*", F.lit(i).alias("_input"), F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.file_block_start").alias("_block"))
        rows = df if rows is None else rows.unionByName(df)
    if not positions:
        return finish(rows)
    split = bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return _with_positions(finish(rows), len(rows.inputFiles()) + estimated_bytes(rows) // split)


def _with_positions(rows: DataFrame, blocks: int) -> DataFrame:
    """Position over all inputs: input, file, block of the file, row in the block.

    Rows of a block are read in order by one task, so an increasing id orders them; it is written out with the rows
    because a second scan could pack blocks into tasks differently. Offsets have one row for each of about `blocks`
    blocks.
    """
    frozen = freeze(rows.withColumn("_id", F.monotonically_increasing_id()))
    by = ["_input", "_file", "_block"]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = frozen.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).select(
        *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return frozen.join(broadcast_if(offsets, blocks), by).withColumn("pos", F.col("_id") + F.col("_shift")).drop(*by, "_id", "_shift")


def read_csv(spark: SparkSession, paths: str | Sequence[str], positions: bool = False) -> DataFrame:
    """21 comma-separated integers per line, blanks after commas allowed; a line that does not parse is an error."""
    return _read(spark, paths, FLOW_SCHEMA, ",", positions, lambda df: df)


def write_csv(flows: DataFrame, path: str, mode: str = "error") -> None:
    flows.select(*FIELDS).write.mode(mode).csv(path)


def read_pipe(spark: SparkSession, paths: str | Sequence[str], positions: bool = False) -> DataFrame:
    """22 pipe-separated integers per line; autonomous systems, TCP flags and type of service are dropped."""

    def finish(df: DataFrame) -> DataFrame:
        times = {
            "first": idiv(F.col("first"), 1000), "first_ms": F.col("first") % 1000,
            "last": idiv(F.col("last"), 1000), "last_ms": F.col("last") % 1000,
            "aggs": F.lit(0),
        }
        extra = [c for c in df.columns if c.startswith("_")]
        return as_flows(df.select(*[times.get(f, F.col(f) if f in PIPE_FIELDS else None).alias(f) for f in FIELDS], *extra))

    return _read(spark, paths, PIPE_SCHEMA, "|", positions, finish)


def write_pipe(flows: DataFrame, path: str, mode: str = "error") -> None:
    """The same text with zeros in the dropped fields."""
    values = {"first": F.col("first") * 1000 + F.col("first_ms"), "last": F.col("last") * 1000 + F.col("last_ms")}
    zero = [f for f in PIPE_FIELDS if f not in FIELDS]
    cols = [values.get(f, F.lit(0) if f in zero else F.col(f)).alias(f) for f in PIPE_FIELDS]
    flows.select(*cols).write.mode(mode).csv(path, sep="|")
