"""Model loops, thresholds and occupancy against brute force."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from weirflow.operators import evaluation as E
from weirflow.operators import learning as L
from weirflow.operators import occupancy as O
from weirflow.operators import reduction as R
from weirflow.operators.distribution import gap_index
from weirflow.operators.features import feature_array, with_features
from weirflow.operators.labels import draw_column, fold_sizes, size_profile, top_sample, with_folds
from weirflow.sources.decisions import pack_decisions, read_decisions, unpack_decisions


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for pos in range(600):
        dp = rng.choice([80, 443, 53])
        packets = rng.randrange(1, 40) * (50 if dp == 443 else 1)
        first = pos * 2
        rows.append((pos, rng.randrange(1024, 60000), 10 + pos % 7, 99 + pos % 5, dp, 6, first, first + rng.randrange(30), packets, packets * 100))
    return spark.createDataFrame(rows, "pos long, sp int, sa3 long, da3 long, dp int, prot int, first long, last long, packets long, octets long").cache()


def test_classify(spark, table):
    algos = {"DecisionTree": lambda seed: DecisionTreeClassifier(maxDepth=4, seed=seed)}
    rows = L.classify(table, folds=2, kinds=["bits"], algos=algos, coverages=[0.8], ratio=0.5, modes=("train", "test"), with_occupancy=True).collect()
    assert len(rows) == 2 * 2 * 2
    for r in rows:
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 300
        if r["algo"] == "Data":
            assert r["fp"] == r["fn"] == 0 and 0.75 < r["coverage"] < 0.8
            assert 0 < r["mean_coverage"] <= 1 <= r["mean_reduction"]
        else:
            assert len(r["importances"]) == 104 and r["depth_max"] <= 4 and r["tp"] > 0
            assert r["leaves_max"] == r["leaves_min"] >= 2


def test_regress_and_tune(spark, table):
    algos = {"DecisionTree": lambda seed: DecisionTreeRegressor(maxDepth=5, seed=seed)}
    rows = L.regress(table, folds=2, kinds=["raw"], algos=algos, modes=("test",)).collect()
    # squared weights favour large flows, so R^2 may be far below 0
    assert len(rows) == 2 * 2 * 64 and all(r["r2"] <= 1 for r in rows)
    tuned = L.tune(table, trees=[3], depths=[2, 4], leaves=[1], folds=2, ratio=0.5).collect()
    assert sorted(r["rank"] for r in tuned)[0] == 1 and len(tuned) == 2 and all(r["rows"] == 600 for r in tuned)


def test_thresholds_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(64, 10**6), float(rng.randrange(0, 10**6))) for _ in range(500)] + [(128, 128.0), (64, 64.0)]
    cuts = R.thresholds(40)
    df = spark.createDataFrame(rows, "octets long, prediction double")
    got = {r["threshold"]: r for r in L.threshold_scores(df, cuts).collect()}
    curve = {r["threshold"]: r for r in R.reduction_curve(df, "prediction", cuts).collect()}
    for c in cuts:
        chosen = [o for o, p in rows if p > c]
        assert got[c]["tp"] == sum(1 for o, p in rows if p > c and o > c)
        assert got[c]["fn"] == sum(1 for o, p in rows if p <= c and o > c)
        assert (c in curve) == bool(chosen)
        if chosen:
            assert got[c]["coverage"] == pytest.approx(sum(chosen) / sum(o for o, _ in rows))
            assert curve[c]["reduction"] == pytest.approx(len(rows) / len(chosen))


def test_occupancy_brute_force(spark, table):
    rows = table.collect()
    for kwargs in ({}, {"pps": 20, "fps": 3}):
        flows, octets = [0] * 900, [0.0] * 900
        for n, r in enumerate(rows):
            elapsed = r["packets"] // 20 + 1 if kwargs else r["last"] - r["first"] + 1
            start = n // 3 if kwargs else r["first"]
            if r["octets"] > 2000:
                for s in range(start, min(start + elapsed + 10, 900)):
                    flows[s] += 1
                for s in range(start, min(start + elapsed, 900)):
                    octets[s] += r["octets"] / elapsed
        got = O.occupancy(table, "octets > 2000", timeout=10, seconds=900, **kwargs).orderBy("second").collect()
        assert [r["flows"] for r in got] == flows
        assert [r["octets"] for r in got] == pytest.approx(octets, abs=1e-3)


def test_confidence_of_many_rounds(spark):
    df = spark.range(60).select(F.lit("a").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    r = E.confidence(df, ["k"], ["v"]).first()
    assert r["v_conf"] == pytest.approx(2.000995 * df.agg(F.stddev_samp("v")).first()[0] / 60**0.5, rel=1e-5)


def test_occupancy_of_levels_and_masks_equals_single_series(spark, table):
    cuts = [500.0, 2000.0, 40_000.0, 10**9]
    for kwargs in ({}, {"pps": 20, "fps": 3}):
        levels = O.occupancy_levels(table, gap_index(F.col("octets").cast("double"), cuts), len(cuts), timeout=10, seconds=400, **kwargs)
        masks = O.occupancy_masks(table, [F.col("octets") > c for c in cuts[::-1]] + [F.lit(None).cast("boolean")], timeout=10, seconds=400, **kwargs)
        got = [{(r["level"], r["second"]): (r["flows"], r["octets"]) for r in df.collect()} for df in (levels, masks)]
        assert len(got[0]) == 5 * 400 and len(got[1]) == 6 * 400
        for i, c in [(O.ALL, 0.0), *enumerate(cuts)]:
            want = {r["second"]: (r["flows"], r["octets"]) for r in O.occupancy(table, F.col("octets") > c, timeout=10, seconds=400, **kwargs).collect()}
            for second, w in want.items():
                assert got[0][i, second] == w
                assert got[1][i if i == O.ALL else 3 - i, second] == w
        assert all(got[1][4, s] == (0, 0.0) for s in range(400))
    ratios = {r["level"]: r for r in O.occupancy_ratios(O.occupancy_levels(table, gap_index(F.col("octets").cast("double"), cuts), len(cuts))).collect()}
    one = O.occupancy_ratio(O.occupancy(table), O.occupancy(table, F.col("octets") > 2000)).first()
    assert {k: ratios[1][k] for k in one.asDict()} == one.asDict()
    assert ratios[3]["mean_reduction"] is None and ratios[3]["mean_coverage"] == 0


def test_a_broken_time_is_an_error(spark):
    rows = spark.createDataFrame([(0, 0, 0, 5, 500), (1, 4 * 10**9, 4 * 10**9, 5, 500)], "pos long, first long, last long, packets long, octets long")
    with pytest.raises(ValueError, match="span"):
        O.occupancy(rows)
    assert O.occupancy(rows, seconds=10).count() == 10


def test_all_levels_decide_in_one_frame(spark, table):
    train = with_features(table, "raw").select("features", (F.col("octets") > 1000).cast("double").alias("a"), (F.col("octets") > 9000).cast("double").alias("b"))
    models = [DecisionTreeClassifier(maxDepth=3, labelCol=c).fit(train) for c in "ab"]
    got = {r["pos"]: r["decided"] for r in L.decide(table, "raw", models, ["pos", "octets"]).collect()}
    for i, m in enumerate(models):
        for r in m.transform(with_features(table, "raw")).select("pos", "prediction").collect():
            assert got[r["pos"]][i] == (r["prediction"] == 1)
    labels = [F.col("octets") > 1000, F.col("octets") > 10**9]
    rows = L.level_scores(table, labels, labels).orderBy("level").collect()
    assert rows[0]["tp"] + rows[0]["tn"] == 600 and rows[0]["fp"] == rows[0]["fn"] == 0
    assert (rows[1]["coverage"], rows[1]["reduction"], rows[1]["tp"]) == (0, None, 0)


def test_stored_decisions_and_ratios_of_regressors(spark, table, tmp_path):
    algos = {"DecisionTree": lambda seed: DecisionTreeRegressor(maxDepth=4, seed=seed)}
    cuts = [500.0, 5000.0, 10**9]
    rows = L.regress(table, folds=2, kinds=["raw"], algos=algos, cuts=cuts, modes=("test",), with_occupancy=True, store=str(tmp_path / "d")).collect()
    assert len(rows) == 2 * 2 * 3
    for r in rows:
        if r["algo"] == "Data":
            assert r["r2"] == 1 and r["fp"] == r["fn"] == 0
        assert r["mean_coverage"] is not None and (r["coverage"] > 0 or r["mean_reduction"] is None)
    octets = {r["pos"]: r["octets"] for r in table.collect()}
    stored = read_decisions(spark, str(tmp_path / "d")).collect()
    assert len(stored) == 2 * 2 * 2 * 3 * 300  # algorithms, kinds, folds, levels, flows
    for r in stored:
        if r["kind"] == "true" or r["algo"] == "Data":
            assert r["decision"] == (octets[r["pos"]] > cuts[r["level"]])
    told = {(r["algo"], r["fold"], r["threshold"]): r["tp"] + r["fp"] for r in rows}
    for (algo, fold, cut), n in told.items():
        assert n == sum(r["decision"] for r in stored if (r["algo"], r["fold"], cuts[r["level"]], r["kind"]) == (algo, fold, cut, "predicted"))


def test_packed_blocks_keep_holes_and_nulls(spark):
    rng = random.Random(3)
    rows = [(p, rng.choice([True, False, None]), rng.random() < 0.5) for p in rng.sample(range(300_000), 500) + [63, 64, 65535, 65536]]
    rows = list({r[0]: r for r in rows}.values()) + [(None, True, True)]
    df = spark.createDataFrame(rows, "pos long, a boolean, b boolean").repartition(5)
    packed = pack_decisions(df, [F.col("a"), F.col("b")])
    assert packed.count() == 2 * len({r[0] // 65536 for r in rows if r[0] is not None})
    got = {(r["level"], r["pos"]): r["decision"] for r in unpack_decisions(packed).collect()}
    assert got == {(i, r[0]): bool(r[1 + i]) for r in rows if r[0] is not None for i in range(2)}


def test_scores_of_a_grid_equal_single_scores(spark):
    rng = random.Random(5)
    rows = [(o := rng.randrange(64, 10**6), [o * rng.uniform(0.2, 3) for _ in range(3)]) for _ in range(400)]
    df = spark.createDataFrame(rows, "octets long, predictions array<double>")
    got = {r["model"]: r["score"] for r in L.tune_scores(df).collect()}
    for i in range(3):
        assert got[i] == pytest.approx(R.reduction_score(df.withColumn("predicted", F.col("predictions")[i])).first()["score"])


def test_a_grid_reads_its_predictions_once(spark):
    rows = [(64 + 1000 * i, [float(1000 * i), 500.0]) for i in range(200)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "octets long, predictions array<double>").mapInArrow(seen, "octets long, predictions array<double>")
    assert L.tune_scores(df).count() == 2
    assert read.value == 200


def test_levels_beyond_one_long(spark, table):
    cuts = [i * 400 for i in range(40)]
    labels, decisions = [F.col("octets") > c for c in cuts], [F.col("packets") * 50 > c for c in cuts]
    got = {r["level"]: r for r in L.level_scores(table, labels, decisions).collect()}
    rows = table.collect()
    assert sorted(got) == list(range(40))
    for i, c in enumerate(cuts):
        assert got[i]["tp"] == sum(r["octets"] > c and r["packets"] * 50 > c for r in rows)
        assert got[i]["fn"] == sum(r["octets"] > c and r["packets"] * 50 <= c for r in rows)
        assert got[i]["fp"] == 0 and got[i]["tn"] + got[i]["fn"] + got[i]["tp"] == 600


def test_one_pass_of_sizes_serves_all_folds(spark, table):
    tagged = with_folds(table, 3)
    sizes = fold_sizes(tagged)
    for k in range(3):
        for part in (F.col("fold") == k, F.col("fold") != k):
            assert {tuple(r) for r in sizes(part).collect()} == {tuple(r) for r in size_profile(tagged.filter(part)).collect()}
        plain = top_sample(tagged.filter(F.col("fold") != k), 0.3, 5)
        drawn = top_sample(tagged.filter(F.col("fold") != k).withColumn("d", draw_column(5)), 0.3, 5, draw="d", sizes=sizes(F.col("fold") != k))
        assert sorted(r["pos"] for r in plain.collect()) == sorted(r["pos"] for r in drawn.collect())


def test_bits_and_short_windows_cost_no_more_than_they_need(spark, table):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    vectors = with_features(table, "bits")
    assert "lambda" not in plan(vectors)  # lambdas are interpreted value by value
    for r in vectors.withColumn("bits", feature_array("bits")).limit(50).collect():
        assert list(r["features"]) == r["bits"] and len(r["bits"]) == 104
    placed, origin, _ = O._placed(table, None, None, 15, 10)
    lines = plan(O._steps(placed, origin, 10, 15, [])).splitlines()
    spread = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert any("Filter" in line and "least" in line for line in lines[spread:])
