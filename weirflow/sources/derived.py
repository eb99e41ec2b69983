"""Files of derived frames: histograms, series, mixtures, experiment results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.operators.mixture import MIXTURE_SCHEMA
from weirflow.session import freeze


def write_histogram(histogram: DataFrame, path: str, single: bool = False, mode: str = "error") -> None:
    """Header CSV sorted by bin; `single` makes one file (log-binned histograms, which are small)."""
    rows = histogram.coalesce(1).sortWithinPartitions("bin_lo") if single else histogram.orderBy("bin_lo")
    rows.write.mode(mode).csv(path, header=True)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """All columns as bigint; sums of squares (`*_ssq`) are dropped."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(c).cast("long").alias(c) for c in raw.columns if not c.endswith("_ssq")])


def write_series(dense_series: DataFrame, path: str, mode: str = "error") -> None:
    """One text file per metric and day with a line per second, in order; a day has 86400 lines."""
    for metric in [c for c in dense_series.columns if c not in ("day", "second")]:
        lines = dense_series.select("day", "second", F.col(metric).cast("string").alias("value"))
        ordered = lines.repartition("day").sortWithinPartitions("day", "second")
        ordered.select("day", "value").write.mode(mode).partitionBy("day").text(f"{path}/{metric}")


def read_series(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    """`(day, second, metrics…)` back from the files, the second being the line number.

    Lines are numbered per block of a file and shifted by the blocks before it.
    """
    lines = None
    for metric in metrics:
        text = spark.read.text(f"{path}/{metric}").select(
            F.lit(metric).alias("metric"), F.col("day").cast("long").alias("day"), F.col("value").cast("long").alias("value"),
            F.col("_metadata.file_block_start").alias("block"))
        lines = text if lines is None else lines.unionByName(text)
    frozen = freeze(lines.withColumn("id", F.monotonically_increasing_id()))
    by = ["metric", "day", "block"]
    before = Window.partitionBy("metric", "day").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = frozen.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("first")).select(
        *by, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = frozen.join(blocks, by).withColumn("second", (F.col("id") + F.col("shift")).cast("int"))
    return numbered.groupBy("day", "second").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def write_mixtures(mixtures: DataFrame, path: str, mode: str = "error") -> None:
    """`{"sum": n, "mix": [[weight, dist, [params]], …]}` per metric."""
    part = F.concat(F.lit("["), F.col("weight").cast("string"), F.lit(', "'), F.col("dist"), F.lit('", '), F.to_json("params"), F.lit("]"))
    texts = mixtures.withColumn("part", part).groupBy("metric").agg(
        F.max("sum").alias("sum"), F.sort_array(F.collect_list(F.struct("component", "part"))).alias("parts"))
    body = F.concat(F.lit('{"sum": '), F.col("sum").cast("string"), F.lit(', "mix": ['), F.array_join(F.col("parts.part"), ", "), F.lit("]}"))
    texts.select("metric", body.alias("value")).write.mode(mode).partitionBy("metric").text(path)


def read_mixtures(spark: SparkSession, path: str) -> DataFrame:
    """Mixture frame from a folder of JSON files; the metric is the file stem, or the folder the writer made."""
    raw = spark.read.schema("sum bigint, mix array<array<string>>").option("multiLine", True).option(
        "recursiveFileLookup", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    metric = F.coalesce(F.nullif(F.regexp_extract("file", "metric=([^/]+)/", 1), F.lit("")), F.regexp_extract("file", "([^/]+)[.]json$", 1))
    rows = raw.select(metric.alias("metric"), "sum", F.posexplode("mix").alias("component", "c"))
    out = rows.select("metric", "sum", "component", F.col("c")[0].cast("double").alias("weight"), F.col("c")[1].alias("dist"),
                      F.from_json(F.col("c")[2], "array<double>").alias("params"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MIXTURE_SCHEMA])


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Tidy table of experiment results, one row per model, fold and level."""
    results.write.mode(mode).partitionBy("algo").parquet(path)


def discard(df: DataFrame) -> None:
    """Run a plan without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time."""
    return df.toLocalIterator()


def flatten(df: DataFrame, name: str = "value") -> DataFrame:
    """All fields of all rows in one column, row after row."""
    return df.select(F.explode(F.array(*[F.col(c).cast("long") for c in df.columns])).alias(name))
