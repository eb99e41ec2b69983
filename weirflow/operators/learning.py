"""Heavy-hitter classifiers and size regressors with Spark ML, per fold, feature set and level.

Models are independent Spark jobs and run from a small pool of driver threads. All levels of one algorithm decide in one
scan of a part, which leaves one array of decisions per flow; scores, occupancy and stored decisions of all levels come
from that frame, so the number of scans does not grow with the number of levels. Results are a few scalars per level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators import forests
from weirflow.operators.distribution import gap_index
from weirflow.operators.evaluation import COUNTS
from weirflow.operators.features import INPUTS, with_features
from weirflow.operators.labels import coverage_cuts, draw_column, fold_sizes, top_sample, top_split, with_folds
from weirflow.operators.occupancy import occupancy_levels, occupancy_masks, occupancy_ratios
from weirflow.operators.reduction import reduction_scores, thresholds
from weirflow.session import freeze
from weirflow.sources.decisions import pack_decisions, write_decisions

# Levels 1 - 1/b^k, powers of the sample weights, share of flows that train a classifier
COVERAGE_BASE = 1.37972966146121546
COVERAGE_STEPS = 25
CLASSIFY_POWER, REGRESS_POWER = 0.5, 2.0
SAMPLE_RATIO = 0.1
REGRESS_THRESHOLDS = 64

CLASSIFIERS: dict[str, Callable] = {
    "DecisionTree": lambda seed: DecisionTreeClassifier(maxDepth=20, maxBins=256, seed=seed),
    "RandomForest": lambda seed: RandomForestClassifier(maxDepth=20, numTrees=100, maxBins=256, seed=seed),
    "GradientBoosting": lambda seed: GBTClassifier(seed=seed),
}
REGRESSORS: dict[str, Callable] = {
    "DecisionTree": lambda seed: DecisionTreeRegressor(maxDepth=20, maxBins=256, seed=seed),
    "RandomForest": lambda seed: RandomForestRegressor(maxDepth=20, numTrees=100, maxBins=256, seed=seed),
    "GradientBoosting": lambda seed: GBTRegressor(seed=seed),
}
FEATURES = ("raw", "bits", "bytes")
DRAW = "_draw"
TREE_STATS = ["depth_min", "depth_mean", "depth_max", "leaves_min", "leaves_mean", "leaves_max"]
OCCUPANCY = ["min_coverage", "mean_coverage", "max_coverage", "min_reduction", "mean_reduction", "max_reduction"]

_MODEL = [T.StructField(n, T.StringType()) for n in ("algo", "prep", "mode")] + [T.StructField("fold", T.IntegerType())]
_SHAPE = [T.StructField("importances", T.ArrayType(T.DoubleType()))] + [T.StructField(n, T.DoubleType()) for n in TREE_STATS]
CLASSIFY_SCHEMA = T.StructType(
    _MODEL + [T.StructField(n, T.DoubleType()) for n in ("training_coverage", "coverage", "reduction", *OCCUPANCY)]
    + [T.StructField(n, T.LongType()) for n in COUNTS] + _SHAPE)
REGRESS_SCHEMA = T.StructType(
    _MODEL + [T.StructField(n, T.DoubleType()) for n in ("threshold", "coverage", "reduction", *OCCUPANCY, "r2")]
    + [T.StructField(n, T.LongType()) for n in COUNTS] + _SHAPE)
WORD_LEVELS = 31  # levels whose cells of two bits fit a long
OCCUPANCY_WINDOW = 300, 720  # fixed values: seconds over which the ratios are taken


def training_coverages(steps: int = COVERAGE_STEPS) -> list[float]:
    return [1 - COVERAGE_BASE**-k for k in range(1, steps + 1)]


def sample_weight(power: float) -> Column:
    """Weight of a training flow: larger flows count more."""
    return F.pow(F.col("octets").cast("double"), F.lit(power))


def model_shape(model) -> dict:
    """Feature importances; depth and leaves of the trees (a binary tree of n nodes has (n + 1) / 2 leaves)."""
    trees = list(getattr(model, "trees", None) or [model])
    depths, leaves = [t.depth for t in trees], [(t.numNodes + 1) / 2 for t in trees]

    def stats(v):
        return float(min(v)), float(sum(v) / len(v)), float(max(v))

    return {"importances": [float(v) for v in model.featureImportances.toArray()],
            **dict(zip(TREE_STATS, (*stats(depths), *stats(leaves))))}


def _run(spark: SparkSession, tasks: list[Callable[[], list]], parallel: int) -> list:
    if parallel <= 1:
        return [row for task in tasks for row in task()]
    with ThreadPoolExecutor(parallel) as pool:
        return [row for rows in pool.map(lambda t: inheritable_thread_target(spark)(t)(), tasks) for row in rows]


def _frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def _needed(flows: DataFrame, pos: str, more: Sequence[str] = (), seed: int | None = None) -> DataFrame:
    """The columns that models and scores read, and with a seed the numbers of the draw: hashed once for all folds."""
    out = flows.select(*dict.fromkeys([pos, "octets", *more, *[name for name, _ in INPUTS]]))
    return out if seed is None else out.withColumn(DRAW, draw_column(seed, pos))


def level_scores(decided: DataFrame, labels: Sequence[Column], decisions: Sequence[Column]) -> DataFrame:
    """`level, coverage, reduction, tn, fp, fn, tp`: every level's decisions against its labels, from one pass.

    Flows are first summed by their pattern of labels and decisions, two bits a level in as many longs as it takes,
    map-side; only patterns are spread over levels.
    """
    cells = [F.coalesce(t.cast("long"), F.lit(0)) * 2 + F.coalesce(d.cast("long"), F.lit(0)) for t, d in zip(labels, decisions)]
    words = [cells[i:i + WORD_LEVELS] for i in range(0, len(cells), WORD_LEVELS)]
    names = [f"_w{i}" for i in range(len(words))]
    packed = [sum((F.shiftleft(c, 2 * i) for i, c in enumerate(word)), F.lit(0).cast("long")).alias(n) for word, n in zip(words, names)]
    patterns = decided.select("octets", *packed).groupBy(*names).agg(F.count("*").alias("n"), F.sum("octets").alias("o"))
    at = patterns.select("n", "o", F.posexplode(F.array(*[
        F.shiftright(n, 2 * i).bitwiseAND(F.lit(3)) for word, n in zip(words, names) for i in range(len(word))])).alias("level", "cell"))
    n, o, selected = F.col("n"), F.col("o"), F.col("cell").isin(1, 3)

    def counted(cell: int) -> Column:
        return F.sum(F.when(F.col("cell") == cell, n).otherwise(0))

    return at.groupBy("level").agg(
        F.try_divide(F.sum(F.when(selected, o).otherwise(0)), F.sum(o)).alias("coverage"),
        F.try_divide(F.sum(n), F.sum(F.when(selected, n))).alias("reduction"), *[counted(i).alias(c) for i, c in enumerate(COUNTS)])


def decide(part: DataFrame, prep: str, models: Sequence, columns: Sequence[str]) -> DataFrame:
    """`columns` of a part and `decided`, one boolean per model: all models predict in the same scan, which is written once."""
    out = with_features(part.select(*dict.fromkeys([*columns, *[name for name, _ in INPUTS]])), prep)
    for i, model in enumerate(models):
        named = model.copy().setPredictionCol(f"_d{i}")
        for other in ("rawPredictionCol", "probabilityCol"):  # not needed
            if named.hasParam(other):
                named.set(named.getParam(other), "")
        out = named.transform(out)
    return freeze(out.select(*columns, F.array(*[F.col(f"_d{i}") == 1 for i in range(len(models))]).alias("decided")))


def classify(flows: DataFrame, folds: int = 5, kinds: Sequence[str] = FEATURES, algos: dict[str, Callable] | None = None,
             coverages: Sequence[float] | None = None, seed: int = 0, modes: Sequence[str] = ("test",),
             ratio: float = SAMPLE_RATIO, with_occupancy: bool = False, parallel: int = 4, pos: str = "pos",
             pps: int | None = None, fps: int | None = None, timeout: int = 15, store: str | None = None) -> DataFrame:
    """Train on large and random flows of the other folds, decide on the fold, and score; tidy result rows.

    "Data" is the pseudo-model that decides by the true label. `with_occupancy` adds flow table ratios per second,
    with starts, durations and timeout as in `occupancy`. `store` names a folder for the packed true and predicted
    decisions of every model, fold and level (`weirflow.sources.decisions`).
    """
    algos = CLASSIFIERS if algos is None else algos
    coverages = list(coverages or training_coverages())
    spark = flows.sparkSession
    levels = range(len(coverages))
    timed = ["packets", "first", "last"] if with_occupancy else []
    tagged = freeze(with_folds(_needed(flows, pos, timed, seed if algos and kinds else None), folds, pos))
    sizes = fold_sizes(tagged)
    rows: list[dict] = []
    for fold in range(folds):
        own = F.col("fold") == fold
        parts = {"train": tagged.filter(F.col("fold") != fold), "test": tagged.filter(own)}
        train_sizes = sizes(F.col("fold") != fold)
        train_cuts = coverage_cuts(parts["train"], coverages, pos, train_sizes)
        cuts = {m: train_cuts if m == "train" else coverage_cuts(parts["test"], coverages, pos, sizes(own)) for m in modes}
        inputs = {}
        if algos and kinds:
            sample = freeze(top_sample(parts["train"], ratio, seed, pos, draw=DRAW, sizes=train_sizes).withColumn("weight", sample_weight(CLASSIFY_POWER)))
            inputs = {prep: freeze(with_features(sample, prep).select("features", "weight", "octets", pos)) for prep in kinds}

        def fit(prep, algo, level, inputs=inputs, train_cuts=train_cuts):
            data = inputs[prep].withColumn("label", train_cuts[level].column(pos=pos).cast("double"))
            return [algos[algo](seed).setWeightCol("weight").fit(data)]

        def score(prep, algo, mode, models, fold=fold, parts=parts, cuts=cuts):
            labels = [cut.column(pos=pos) for cut in cuts[mode]]
            columns = [pos, "octets", *timed]
            if models is None:
                data, decisions = parts[mode].select(*columns), labels
            else:
                data = decide(parts[mode], prep, models, columns)
                decisions = [F.col("decided")[i] for i in levels]
            told = {"algo": algo, "prep": prep, "mode": mode, "fold": fold}
            ratios = {}
            if with_occupancy:
                series = occupancy_masks(data, decisions, pps, fps, timeout, OCCUPANCY_WINDOW[1])
                ratios = {r["level"]: r.asDict() for r in occupancy_ratios(series, *OCCUPANCY_WINDOW).collect()}
            if store:
                store_decisions(data, {"true": labels, "predicted": decisions}, told, store, pos)
            return [{**told, "training_coverage": coverages[r["level"]], **ratios.get(r["level"], {}), **r.asDict(),
                     **(model_shape(models[r["level"]]) if models is not None else {})}
                    for r in level_scores(data, labels, decisions).collect()]  # one row per level

        keys = list(product(kinds, algos))
        fitted = iter(_run(spark, [lambda a=a: fit(*a) for a in product(kinds, algos, levels)], parallel))
        trained = {key: [next(fitted) for _ in levels] for key in keys}
        tasks = [lambda a=(*key, m, models), score=score: score(*a) for key, models in trained.items() for m in modes]
        tasks += [lambda m=m, score=score: score("raw", "Data", m, None) for m in modes]
        rows += _run(spark, tasks, parallel)
    return _frame(spark, rows, CLASSIFY_SCHEMA)


def store_decisions(data: DataFrame, kinds: dict[str, Sequence[Column]], told: dict, path: str, pos: str = "pos") -> None:
    """Write the packed decisions of one model on one part; its description names the folder, so models store at once."""
    for kind, decisions in kinds.items():
        write_decisions(pack_decisions(data, decisions, pos), path, {**told, "kind": kind})


def threshold_scores(predicted: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Coverage, reduction and confusion at every threshold, from one pass.

    Flows are summed per pair of intervals (predicted, true), at most (n + 1)^2 groups; thresholds meet only these.
    """
    groups = predicted.groupBy(gap_index(F.col("prediction"), cuts).alias("p"), gap_index(F.col("octets").cast("double"), cuts).alias("t")).agg(
        F.count("*").alias("n"), F.sum("octets").alias("o"))
    at = groups.withColumn("c", F.explode(F.arrays_zip(
        F.sequence(F.lit(0), F.lit(len(cuts) - 1)).alias("i"), F.array(*[F.lit(float(c)) for c in cuts]).alias("threshold"))))
    p, t = F.col("p") > F.col("c.i"), F.col("t") > F.col("c.i")
    n = F.col("n")
    return at.groupBy(F.col("c.threshold").alias("threshold")).agg(
        F.try_divide(F.sum(F.when(p, F.col("o")).otherwise(0)), F.sum("o")).alias("coverage"),
        F.try_divide(F.sum(n), F.sum(F.when(p, n))).alias("reduction"),
        *[F.sum(F.when(c, n).otherwise(0)).alias(name) for name, c in zip(COUNTS, (~t & ~p, ~t & p, t & ~p, t & p))])


def regress(flows: DataFrame, folds: int = 5, kinds: Sequence[str] = FEATURES, algos: dict[str, Callable] | None = None,
            cuts: Sequence[float] | None = None, seed: int = 0, modes: Sequence[str] = ("train", "test"), parallel: int = 4,
            pos: str = "pos", with_occupancy: bool = False, pps: int | None = None, fps: int | None = None, timeout: int = 15,
            store: str | None = None) -> DataFrame:
    """Predict flow sizes per fold and decide by thresholds on the prediction; tidy result rows with R^2.

    "Data" is the pseudo-model that predicts the true size. `with_occupancy` adds the flow table ratios per second of
    every threshold, all from one aggregate; `store` keeps the packed true and predicted decisions.
    """
    algos = REGRESSORS if algos is None else algos
    cuts = list(cuts or thresholds(REGRESS_THRESHOLDS))
    timed = ["packets", "first", "last"] if with_occupancy else []
    tagged = freeze(with_folds(_needed(flows, pos, timed), folds, pos))
    octets = F.col("octets").cast("double")

    def score(told, predicted, shape):
        error = F.sum(F.pow(F.col("octets") - F.col("prediction"), F.lit(2)))
        r2 = predicted.agg(F.try_divide(error, F.var_pop("octets") * F.count("*")).alias("u")).first()["u"]
        ratios = {}
        if with_occupancy:
            series = occupancy_levels(predicted, gap_index(F.col("prediction"), cuts), len(cuts), pps, fps, timeout, OCCUPANCY_WINDOW[1])
            ratios = {cuts[r["level"]]: r.asDict() for r in occupancy_ratios(series, *OCCUPANCY_WINDOW).collect()}
        if store:
            store_decisions(predicted, {"true": [octets > c for c in cuts], "predicted": [F.col("prediction") > c for c in cuts]}, told, store, pos)
        return [{**told, "r2": None if r2 is None else 1 - r2, **ratios.get(r["threshold"], {}), **r.asDict(), **shape}
                for r in threshold_scores(predicted, cuts).collect()]  # one row per threshold

    def train(fold, prep, algo):
        parts = {"train": tagged.filter(F.col("fold") != fold), "test": tagged.filter(F.col("fold") == fold)}
        model, shape = None, {}
        if algo != "Data":
            data = with_features(parts["train"], prep).select("features", octets.alias("label"), sample_weight(REGRESS_POWER).alias("weight"))
            model = algos[algo](seed).setWeightCol("weight").fit(data)
            shape = model_shape(model)
        out = []
        for mode in modes:
            columns = [pos, "octets", *timed]
            if model is None:
                predicted = parts[mode].select(*columns, octets.alias("prediction"))
            else:  # written once: scores, ratios and stored decisions all read it
                predicted = freeze(model.transform(with_features(parts[mode], prep)).select(*columns, "prediction"))
            out += score({"algo": algo, "prep": prep, "mode": mode, "fold": fold}, predicted, shape)
        return out

    tasks = [lambda a=a: train(*a) for a in [*product(range(folds), kinds, algos), *product(range(folds), ["raw"], ["Data"])]]
    return _frame(flows.sparkSession, _run(flows.sparkSession, tasks, parallel), REGRESS_SCHEMA)


TUNE_SCHEMA = T.StructType([
    T.StructField("trees", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("leaf", T.IntegerType()),
    T.StructField("fold", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("rows", T.LongType())])


def tune_scores(predicted: DataFrame, predictions: str = "predictions") -> DataFrame:
    """`model, score`: the reduction at 80 % coverage of every model, from one pass over an array of predictions per flow.

    Flows meet each model as a prediction and octets, summed map-side into 26 groups per model.
    """
    return reduction_scores(predicted.select("octets", F.posexplode(predictions).alias("model", "_p")), "_p", ["model"])


def tune(flows: DataFrame, trees: Sequence[int] = (23,), depths: Sequence[int] = tuple(range(20, 31)),
         leaves: Sequence[int] = (1, 2, 3, 4), folds: int = 5, ratio: float = SAMPLE_RATIO, prep: str = "bytes", seed: int = 0,
         parallel: int = 4, pos: str = "pos", model: Callable | None = None) -> DataFrame:
    """Grid search of forests by the reduction at 80 % coverage on folds trained on large and random flows.

    One row per grid point: mean, deviation and rank of the score, and the rows of the test folds. Forests over bytes or
    bits are grown once per leaf size and cut for the other grid points (`operators.forests`), which gives what each point
    grown by itself gives. `model(trees, depth, leaf)` gives another estimator, fitted at every grid point.
    """
    grid = list(product(trees, depths, leaves))
    spark = flows.sparkSession
    make = model or (lambda t, d, leaf: RandomForestRegressor(numTrees=t, maxDepth=d, minInstancesPerNode=leaf, maxBins=256, seed=seed))
    rows: list[dict] = []
    for fold, sample, test in top_split(freeze(_needed(flows, pos, seed=seed)), folds, ratio, seed, pos, DRAW):
        if model is None and prep in forests.KINDS:
            grown = forests.grow_forest(freeze(sample), prep, max(trees), max(depths), leaves, seed, pos)
            predicted, done = forests.grid_predictions(test, prep, grown, trees, depths, len(leaves))
        else:
            train = freeze(with_features(sample, prep).select("features", F.col("octets").cast("double").alias("label")))
            models = _run(spark, [lambda a=a, train=train: [make(*a).fit(train)] for a in grid], parallel)
            out = with_features(test, prep)
            for i, m in enumerate(models):
                out = m.copy().setPredictionCol(f"_d{i}").transform(out)
            # written once: inlined into the sums, every tree would be walked again and again
            predicted = freeze(out.select("octets", F.array(*[f"_d{i}" for i in range(len(models))]).alias("predictions")))
            done = None
        scores = {r["model"]: r["score"] for r in tune_scores(predicted).collect()}  # one row per grid point
        if done is not None:
            done()
        n = test.count()
        rows += [{"trees": t, "depth": d, "leaf": leaf, "fold": fold, "score": scores.get(i), "rows": n} for i, (t, d, leaf) in enumerate(grid)]
    scores = _frame(spark, rows, TUNE_SCHEMA)
    mean = scores.groupBy("trees", "depth", "leaf").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.sum("rows").alias("rows"))
    return mean.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last("mean_score"))))
