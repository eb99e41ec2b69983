"""Slices, positions, histograms, series, labels, occupancy on small frames."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.operators import coverage as C
from weirflow.operators import distribution as D
from weirflow.operators import histogram as H
from weirflow.operators import labels as L
from weirflow.operators import positions, sort
from weirflow.operators import series as S
from weirflow.operators import slicing as P
from weirflow.operators.positions import (
    nth_positions,
    nth_positions_by,
    number_rows,
    prefix_sums,
    rank_rows,
    self_bucketed,
    with_neighbours,
)

VALUES = [-1, 0, 1, 17, 101, None]


@pytest.mark.parametrize("where", [None, "v % 3 = 0", "v < 0"])
def test_slice_matrix(spark, where):
    rows = [(i, (i * 37) % 100 if i % 5 else 3) for i in range(100)]
    df = spark.createDataFrame(rows, "pos long, v long").repartition(3).cache()
    keep = {None: lambda v: True, "v % 3 = 0": lambda v: v % 3 == 0, "v < 0": lambda v: False}[where]
    for skip_in, count_in, skip_out, count_out in itertools.product([-1, 17], VALUES, [0, 1, 101], [None, 0, 5]):
        want = rows[max(skip_in, 0):]
        want = want if count_in is None else want[:max(count_in, 0)]
        want = [r for r in want if keep(r[1])][skip_out:]
        want = want if count_out is None else want[:count_out]
        if (skip_in, count_in) in ((-1, None), (17, 17), (17, -1)):
            got = P.convert(df, skip_in, count_in, where, skip_out, count_out).orderBy("pos").collect()
            assert [tuple(r) for r in got] == want
    assert P.cut_range(2, 10, 3, None) == (5, 7)
    assert P.cut_range(-1, None, 3, 4) == (3, 4)
    assert P.cut_range(0, 2, 5, None) == (5, 0)


def test_positions_in_many_buckets(spark):
    pos = random.Random(1).sample(range(10_000), 300)
    df = spark.createDataFrame([(p,) for p in pos], "pos long")
    ranked = sorted(pos)
    assert nth_positions(df, [0, 5, 299, 300], width=64) == [ranked[0], ranked[5], ranked[299], None]


def test_ranks_are_dense_with_one_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"), F.col("id").alias("pos"))
    got = [(r["rank"], r["k"], r["pos"]) for r in rank_rows(df, [F.asc("k"), F.asc("pos")]).collect()]
    want = sorted((7 if i % 3 == 0 else i % 11, i) for i in range(2000))
    assert sorted(got) == [(i, *w) for i, w in enumerate(want)]
    assert sorted(r["n"] for r in number_rows(spark.range(50), "n").collect()) == list(range(50))


@pytest.mark.parametrize("descending", [False, True])
def test_bucketed_prefix_sums(spark, descending):
    df = spark.createDataFrame([(i * 3, i) for i in range(200)], "x long, v long")
    one = prefix_sums(df, "x", {"s": "v"}, None, descending)
    two = prefix_sums(df, "x", {"s": "v"}, F.expr("x div 50"), descending)
    assert sorted(one.collect()) == sorted(two.collect())


def test_bins(spark):
    xs = [1, 4095, 4096, 8191, 8192, 16385]
    df = spark.createDataFrame([(x, x * 100) for x in xs], "packets long, octets long")
    bins = sorted((r["bin_lo"], r["bin_hi"]) for r in H.hist(df, "length", 12).collect())
    assert bins == [(1, 2), (4095, 4096), (4096, 4098), (8190, 8192), (8192, 8196), (16384, 16392)]
    assert sorted(r["bin_hi"] - r["bin_lo"] for r in H.hist(df, "length", 60).collect()) == [1] * 6
    assert H.detect_x_value(H.hist(df, "length")) == "length"
    with pytest.raises(ValueError):
        H.detect_x_value(H.hist(df, "size"))


def enumerate_packets(rows, first_n=None):
    out = defaultdict(lambda: [0, 0, 0])
    for first, fms, last, lms, packets, octets in rows:
        d = 0 if packets == 1 else last * 1000 + lms - first * 1000 - fms
        for n in range(packets if first_n is None else min(packets, first_n)):
            cell = out[first + (fms * packets + n * d) // (1000 * packets)]
            cell[0] += n == 0
            cell[1] += 1
            cell[2] += (n + 1) * octets // packets - n * octets // packets
    return {(s // 86400, s % 86400): tuple(v) for s, v in out.items()}


@pytest.mark.parametrize("first_n", [None, 1, 7])
def test_series_packet_by_packet(spark, first_n):
    rng = random.Random(5)
    rows = [(86395, 500, 86404, 20, 900, 12345), (10, 0, 12, 0, 1, 99), (20, 250, 20, 250, 50, 7777), (86399, 999, 86400, 0, 2, 131)]
    for _ in range(200):
        first, fms, d, packets = rng.randrange(86000, 86500), rng.randrange(1000), rng.choice([0, 1, 999, 5000, 60_000]), rng.choice([1, 2, 3, 40, 3000])
        end = first * 1000 + fms + d
        rows.append((first, fms, end // 1000, end % 1000, packets, rng.randrange(64, 10**6)))
    df = spark.createDataFrame(rows, "first long, first_ms int, last long, last_ms int, packets long, octets long")
    got = {(r["day"], r["second"]): (r["flows"], r["packets"], r["octets"]) for r in S.traffic_series(df, first_n).collect()}
    assert {k: v for k, v in got.items() if v[1]} == enumerate_packets(rows, first_n)


def test_labels_with_ties(spark):
    rng = random.Random(2)
    sizes = [rng.choice([100, 100, 100, 700, rng.randrange(64, 5000)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "pos long, octets long").repartition(4)
    order = sorted(range(400), key=lambda i: (-sizes[i], i))
    total = sum(sizes)
    for coverage in (0.0, 0.3, 0.77, 0.95, 1.0, 1.5):
        run, want = 0, set()
        for i in order:
            run += sizes[i]
            if run < total * coverage:
                want.add(i)
        got = {r["pos"] for r in L.label_coverage(df, coverage).filter("decision").collect()}
        assert got == want
    sample = L.top_sample(df, 0.2, seed=1).collect()
    picked = {r["pos"] for r in sample}
    assert len(sample) == len(picked) == 80 and set(order[:40]) <= picked


def test_folds(spark):
    folds = [r["fold"] for r in L.with_folds(spark.range(23).withColumnRenamed("id", "pos"), 5).orderBy("pos").collect()]
    assert folds == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_sampling_curve_in_buckets(spark):
    h = spark.createDataFrame([(i * i + 1, 1000 // (i + 1) + 1) for i in range(60)], "bin_lo long, flows_sum long")
    h = h.select("*", (F.col("bin_lo") * F.col("flows_sum")).alias("packets_sum"), (F.col("bin_lo") * F.col("flows_sum") * 90).alias("octets_sum"))
    one = C.coverage_sampling(h).orderBy("p").collect()
    two = C.coverage_sampling(h, bucket=F.expr("bin_lo div 500")).orderBy("p").collect()
    for a, b in zip(one, two):
        assert a["octets_mean"] == pytest.approx(b["octets_mean"], abs=1e-9)
        assert a["flows_mean"] == pytest.approx(b["flows_mean"], abs=1e-9)


def test_many_order_statistics_in_two_passes(spark):
    rng = random.Random(11)
    rows = [(p, rng.choice([5, 5, 5, 9, 12])) for p in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "pos long, octets long").repartition(7)
    ranked = {v: sorted(p for p, o in rows if o == v) for v in (5, 9, 12)}
    wanted = [(5, 0), (5, 100), (5, len(ranked[5]) - 1), (9, 3), (12, 10**6), (77, 0), (9, -1), (5, 100)]
    got = nth_positions_by(df, "octets", wanted, width=64)
    assert got == {(v, k): ranked[v][k] for v, k in wanted if v in ranked and 0 <= k < len(ranked[v])}
    assert nth_positions_by(df, "octets", []) == {}


def test_frames_bucket_themselves(spark, monkeypatch):
    rng = random.Random(12)
    values = sorted({*range(1, 2000), *(rng.randrange(10**6, 10**6 + 900) for _ in range(500)), *(rng.randrange(10**12) for _ in range(300))})
    df = spark.createDataFrame([(v, rng.randrange(100)) for v in values], "bin_lo long, flows_sum long").repartition(6)
    monkeypatch.setattr(positions, "WINDOW_ROWS", 50)
    bucketed, bucket = self_bucketed(df, "bin_lo")
    sizes = [r["count"] for r in bucketed.groupBy(bucket.alias("b")).count().collect()]
    assert sum(sizes) == len(values) and max(sizes) <= 120 and len(sizes) < len(values) / 10
    rows = bucketed.withColumn("b", bucket).orderBy("bin_lo").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    near = with_neighbours(bucketed, "bin_lo", bucket).orderBy("bin_lo").collect()
    assert [r["_previous"] for r in near] == [None, *values[:-1]] and [r["_next"] for r in near] == [*values[1:], None]
    total, run = sum(r["flows_sum"] for r in rows), 0
    for r, c in zip(rows, D.cdf(df, ["flows"]).orderBy("bin_lo").collect()):
        run += r["flows_sum"]
        assert c["flows_cdf"] == run / total
    assert self_bucketed(df, "bin_lo", 10**6)[1] is None


def test_large_frames_meet_no_single_task(spark, monkeypatch):
    """Only totals and one row per bucket may go to one task."""
    df = spark.range(1, 4001).select(F.col("id").alias("bin_lo"), *[F.lit(1).cast("long").alias(f"{m}_sum") for m in ("flows", "packets", "octets")])
    monkeypatch.setattr(positions, "WINDOW_ROWS", 100)
    for out in (D.cdf(df), D.pdf_points(df), C.coverage_sampling(df, "size")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and not any(c in line for c in ("_at", "_bucket", "_coarse", "sum(_b_")):
                raise AssertionError(line)


def test_ranks_need_no_copy_of_the_rows(spark):
    rng = random.Random(13)
    rows = [(p, rng.randrange(5), "x" * 50) for p in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "pos long, k int, wide string").repartition(5)
    got = sort.sort_ranked(df, ["k"]).orderBy("rank").collect()
    assert [(r["pos"], r["k"], r["rank"]) for r in got] == [(p, k, i) for i, (p, k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))]
