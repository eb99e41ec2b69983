"""Round trips through every source and sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weirflow.operators import histogram as H
from weirflow.operators import mixture as M
from weirflow.operators import series as S
from weirflow.plans.fixtures import flows, with_flows
from weirflow.plans.flow_queries import COLS, DENSE_CTE, hist_sql, traffic_sql
from weirflow.plans.registry import query
from weirflow.session import checkpoint_root
from weirflow.sources import arrays, derived, positioned, text_flows


def new_folder(spark) -> str:
    return f"{checkpoint_root(spark)}/trip-{uuid.uuid4().hex}"


@query("csv_roundtrip", with_flows(f"select {COLS} from f"))
def csv_roundtrip(spark, sf):
    path = new_folder(spark)
    text_flows.write_csv(flows(spark, sf), path)
    return text_flows.read_csv(spark, path, positions=True)


@query("pipe_roundtrip", with_flows(f"select {COLS} from f"))
def pipe_roundtrip(spark, sf):
    path = new_folder(spark)
    text_flows.write_pipe(flows(spark, sf), path)
    return text_flows.read_pipe(spark, path, positions=True)


@query("array_roundtrip", with_flows(f"select {COLS} from f"))
def array_roundtrip(spark, sf):
    path = new_folder(spark)
    arrays.write_arrays(flows(spark, sf), path)
    return arrays.read_arrays(spark, path)


@query("array_slice", with_flows("select pos, packets, octets from f where pos >= 2000 and pos < 5000"))
def array_slice(spark, sf):
    path = new_folder(spark)
    arrays.write_arrays(flows(spark, sf), path)
    return arrays.read_arrays(spark, path, ["packets", "octets"], skip=2000, count=3000, rows_per_partition=1000)


@query("hist_csv_roundtrip", with_flows(hist_sql("size", 12)))
def hist_csv_roundtrip(spark, sf):
    path = new_folder(spark)
    h = H.hist(flows(spark, sf), "size", 12)
    derived.write_histogram(h.withColumn("packets_ssq", F.lit(0)), path, single=True)
    return derived.read_histogram(spark, path)


@query("series_roundtrip", with_flows(traffic_sql() + DENSE_CTE + " select day, second, packets, octets from den"))
def series_roundtrip(spark, sf):
    path = new_folder(spark)
    rows = flows(spark, sf)
    series = S.traffic_series(rows).select("day", "second", "packets", "octets")
    derived.write_series(S.dense(series, S.touched_days(rows)), path)
    return derived.read_series(spark, path, ["packets", "octets"])


@query("mixture_roundtrip", with_flows("""select m.metric, s as "sum", i as component, w as weight, d as dist, array_to_string(p, ';') as params
  from (select 'packets' as metric, cast(sum(packets) as bigint) as s from f union all select 'octets', cast(sum(octets) as bigint) from f) m,
  (values (0, 0.25::double, 'uniform', [0, 6]), (1, 0.75::double, 'lognorm', [2, 0, 20])) c(i, w, d, p)"""))
def mixture_roundtrip(spark, sf):
    path = new_folder(spark)
    parts = F.array(*[
        F.struct(F.lit(i).alias("component"), F.lit(w).alias("weight"), F.lit(d).alias("dist"), F.array(*[F.lit(v) for v in p]).alias("params"))
        for i, (w, d, p) in enumerate([(0.25, "uniform", [0.0, 6.0]), (0.75, "lognorm", [2.0, 0.0, 20.0])])])
    sums = flows(spark, sf).agg(F.map_from_arrays(
        F.array(F.lit("packets"), F.lit("octets")), F.array(F.sum("packets"), F.sum("octets"))).alias("m"))
    mixtures = sums.select(F.explode("m").alias("metric", "sum")).select("metric", "sum", F.inline(parts))
    derived.write_mixtures(mixtures.select(*M.MIXTURE_SCHEMA.names), path)
    back = derived.read_mixtures(spark, path)
    text = F.array_join(F.transform("params", lambda v: v.cast("int").cast("string")), ";")
    return back.withColumn("params", text)


@query("multi_input", with_flows(f"select {COLS} from f where pos >= 1500"))
def multi_input(spark, sf):
    rows = flows(spark, sf)
    first, second = new_folder(spark), new_folder(spark)
    rows.filter("pos < 4000").orderBy("pos").drop("pos").write.parquet(first)
    rows.filter("pos >= 4000").orderBy("pos").drop("pos").write.parquet(second)
    return positioned.read_parquet(spark, [first, second]).filter("pos >= 1500")


@query("results_roundtrip", with_flows("""select case when octets % 2 = 0 then 'even' else 'odd' end as algo, prot, count(*) as n,
  cast(sum(octets) as bigint) as octets from f group by 1, 2"""))
def results_roundtrip(spark, sf):
    """A table of results written by kind and read again."""
    kind = F.when(F.col("octets") % 2 == 0, "even").otherwise("odd").alias("algo")
    path = f"{new_folder(spark)}/results"
    derived.write_results(flows(spark, sf).groupBy(kind, "prot").agg(F.count("*").alias("n"), F.sum("octets").alias("octets")), path)
    return spark.read.parquet(path).select("algo", "prot", "n", "octets")
