"""Queries that train models and queries on streams."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from weirflow.operators import evaluation as E
from weirflow.operators import learning as L
from weirflow.operators import occupancy as O
from weirflow.operators import reduction as R
from weirflow.operators.distribution import gap_index
from weirflow.plans.fixtures import ACTIVE_S, INACTIVE_S, RECORD_KEYS, flows, flows_of, records_of, with_flows
from weirflow.plans.flow_queries import MERGE_CTE
from weirflow.plans.heavy_queries import PREDICTED, predicted_flows
from weirflow.plans.registry import query
from weirflow.plans.source_queries import new_folder
from weirflow.sources import decisions as D
from weirflow.streaming import flows as ST


@query("classify_flows")
def classify_flows(spark, sf):
    algos = {
        "DecisionTree": lambda seed: DecisionTreeClassifier(maxDepth=8, seed=seed),
        "RandomForest": lambda seed: RandomForestClassifier(maxDepth=6, numTrees=8, seed=seed),
    }
    return L.classify(flows(spark, sf), folds=2, kinds=["bytes"], algos=algos, coverages=[0.5, 0.9], seed=1)


@query("regress_flows")
def regress_flows(spark, sf):
    algos = {
        "DecisionTree": lambda seed: DecisionTreeRegressor(maxDepth=8, seed=seed),
        "RandomForest": lambda seed: RandomForestRegressor(maxDepth=6, numTrees=8, seed=seed),
    }
    return L.regress(flows(spark, sf), folds=2, kinds=["raw"], algos=algos, seed=1, modes=["test"])


@query("classify_train_gbt")
def classify_train_gbt(spark, sf):
    """Boosted trees on bits, decided on both parts, with flow table ratios of all levels."""
    algos = {"GradientBoosting": lambda seed: GBTClassifier(maxIter=4, maxDepth=4, seed=seed)}
    return L.classify(flows(spark, sf), folds=2, kinds=["bits"], algos=algos, coverages=L.training_coverages(3), seed=1,
                      modes=["train", "test"], with_occupancy=True)


# the fold of each flow, and what the true label of each level selects in each part: no model is needed for it
_LEVELS = L.training_coverages()
_PARTS = """, n as (select count(*) // 2 as s, count(*) % 2 as b from f),
  ff as (select f.*, case when pos < b * (s + 1) then pos // (s + 1) else b + (pos - b * (s + 1)) // s end as own from f, n),
  pt as (select 'test' as mode, own as fold, ff.* from ff union all select 'train', 1 - own, ff.* from ff),
  rn as (select mode, fold, pos, octets, packets, "first", "last",
      sum(octets) over (partition by mode, fold order by octets desc, pos rows unbounded preceding) as run from pt),
  tt as (select mode, fold, cast(sum(octets) as double) as total, count(*) as n from pt group by 1, 2),
  lv as (select unnest([{levels}]::double[]) as training_coverage),
  dc as (select rn.*, total, n, training_coverage, cast(run as double) < total * training_coverage as d
    from rn join tt using (mode, fold), lv)"""
_TRUE = with_flows(_PARTS.format(levels=", ".join(map(repr, _LEVELS))) + """
  select mode, cast(fold as int) as fold, training_coverage, round(coalesce(sum(octets) filter (where d), 0) / max(total), 12) as coverage,
    round(max(n) / nullif(count(*) filter (where d), 0), 9) as reduction, count(*) filter (where not d) as tn, cast(0 as bigint) as fp,
    cast(0 as bigint) as fn, count(*) filter (where d) as tp
  from dc group by all""")


@query("classify_true", _TRUE)
def classify_true(spark, sf):
    """Rows of the pseudo-model that decides by the true label, on all 25 levels and both parts."""
    rows = L.classify(flows(spark, sf), folds=2, kinds=[], algos={}, modes=["train", "test"])
    return rows.select("mode", "fold", "training_coverage", F.round("coverage", 12).alias("coverage"), F.round("reduction", 9).alias("reduction"), *E.COUNTS)


# cuts of the regressors: series of each threshold by itself
_RATIOS = """, cu as (select i, cast(64 as double) * pow(2, 24 * i / cast(63 as double)) as threshold from range(64) r(i)),
  g as (select *, {predicted} as predicted from f), st as (select min("first") as o from f),
  ev as (select i, "first" - o as s, "last" - "first" + 1 as e, octets from g, st, cu where predicted > threshold
    union all select -1, "first" - o, "last" - "first" + 1, octets from g, st),
  df as (select i, s as second, 1 as d, octets * 1000000 // e as r from ev union all select i, s + e, 0, -(octets * 1000000 // e) from ev
    union all select i, s + e + 15, -1, 0 from ev),
  ps as (select i, second, sum(d) d, sum(r) r from df where second < 720 group by 1, 2),
  gr as (select i, second from (select unnest(generate_series(-1, 63)) as i), (select unnest(generate_series(0, 719)) as second)),
  se as (select i, second, sum(coalesce(d, 0)) over w as flows, cast(sum(coalesce(r, 0)) over w as bigint) / 1000000 as octets
    from gr left join ps using (i, second) window w as (partition by i order by second)),
  rt as (select a.i, b.flows / nullif(a.flows, 0) as r, a.octets / nullif(b.octets, 0) as c
    from se a join se b on b.i = -1 and b.second = a.second where a.i >= 0 and a.second >= 300),
  ra as (select i, round(min(c), 9) min_coverage, round(avg(c), 9) mean_coverage, round(max(c), 9) max_coverage,
    round(min(r), 9) min_reduction, round(avg(r), 9) mean_reduction, round(max(r), 9) max_reduction from rt group by i)"""


@query("occupancy_thresholds", with_flows(_RATIOS.format(predicted=PREDICTED) + " select cast(i as int) as level, * exclude (i) from ra"))
def occupancy_thresholds(spark, sf):
    """Flow table ratios of 64 thresholds on a predicted size, from one aggregate."""
    cuts = R.thresholds(L.REGRESS_THRESHOLDS)
    series = O.occupancy_levels(predicted_flows(spark, sf), gap_index(F.col("predicted"), cuts), len(cuts), seconds=720)
    ratios = O.occupancy_ratios(series)
    return ratios.select("level", *[F.round(c, 9).alias(c) for c in L.OCCUPANCY])


@query("regress_true", with_flows(_RATIOS.format(predicted="cast(octets as double)") + """,
  sc as (select i, threshold, coalesce(sum(octets) filter (where octets > threshold), 0) / cast(sum(octets) as double) as coverage,
    count(*) / nullif(count(*) filter (where octets > threshold), 0) as reduction, count(*) filter (where octets <= threshold) as tn,
    count(*) filter (where octets > threshold) as tp from f, cu group by all)
  select round(threshold, 6) as threshold, round(coverage, 12) coverage, round(reduction, 9) reduction, tn, tp, cast(1 as double) as r2,
    ra.* exclude (i) from sc join ra using (i)"""))
def regress_true(spark, sf):
    """Rows of the pseudo-model that predicts the true size, on one part with all flows."""
    rows = L.regress(flows(spark, sf), folds=1, kinds=[], algos={}, modes=["test"], with_occupancy=True)
    return rows.select(F.round("threshold", 6).alias("threshold"), F.round("coverage", 12).alias("coverage"), F.round("reduction", 9).alias("reduction"),
                       "tn", "tp", "r2", *[F.round(c, 9).alias(c) for c in L.OCCUPANCY])


_STORED = [64.0 * 4**i for i in range(8)]


@query("decisions_roundtrip", with_flows(f""", g as (select *, {PREDICTED} as predicted from f),
  th as (select unnest(generate_series(0, 7)) as level)
  select cast(level as int) as level, pos, predicted > 64 * pow(4, level) as decision from g, th"""))
def decisions_roundtrip(spark, sf):
    """Decisions of eight levels, packed into blocks, written, and read back row by row."""
    path = new_folder(spark)
    D.write_decisions(D.pack_decisions(predicted_flows(spark, sf), [F.col("predicted") > c for c in _STORED]), path)
    return D.read_decisions(spark, path, by=())


@query("tune_regressor")
def tune_regressor(spark, sf):
    """The whole grid: 23 trees, depths 20 to 30, leaves of 1 to 4 flows, five folds."""
    return L.tune(flows(spark, sf))


def _stream(spark, sf, table):
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


@query("merge_stream", f"""with {MERGE_CTE}
  select user_id, pos, start_ms, end_ms, packets, octets, aggs from i where not dropped""")
def merge_stream(spark, sf):
    """Merged flows of the whole table, read as a stream to its end."""
    records, folder = records_of(_stream(spark, sf, "events")), new_folder(spark)
    merged = ST.merge_stream(ST.with_end(records, folder), RECORD_KEYS, INACTIVE_S, ACTIVE_S)
    return ST.run_available(merged, folder, records.schema, {"start_ms": ST.END_MS, "end_ms": ST.END_MS})


@query("series_stream", with_flows("""select "first" // 86400 as day, cast("first" % 86400 as int) as second, count(*) as flows
  from f group by 1, 2"""))
def series_stream(spark, sf):
    rows, folder = flows_of(_stream(spark, sf, "lineitem").withColumn("pos", F.lit(0))).select("first"), new_folder(spark)
    arrivals = ST.arrival_stream(ST.with_end(rows, folder))
    return ST.run_available(arrivals, folder, rows.schema, {"first": ST.END_MS // 1000})
