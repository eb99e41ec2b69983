"""Pseudonyms, mixtures and fits."""

import ipaddress
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.functions.special import gamma_cdf, t_quantile
from weirflow.operators import anonymize as A
from weirflow.operators import fitting as FIT
from weirflow.operators import mixture as M
from weirflow.operators.mixture import Component

# A published test vector of the pseudonym scheme (key, address, pseudonym)
KEY = "boojahyoo3vaeToong0Eijee7Ahz3yee"
VECTOR = ("192.0.2.1", "206.2.124.120")


def test_pseudonym_vector_and_prefixes(spark):
    base = int(ipaddress.ip_address(VECTOR[0]))
    others = [base, base ^ 1, base ^ (1 << 8), base ^ (1 << 31)]
    df = spark.createDataFrame([(a,) for a in others], "a long")
    got = dict((r["a"], r["p"]) for r in df.select("a", A.pseudonym(spark, F.col("a"), KEY).alias("p")).collect())
    assert got[base] == int(ipaddress.ip_address(VECTOR[1]))
    for other in others[1:]:
        assert (got[base] ^ got[other]).bit_length() == (base ^ other).bit_length()
    with pytest.raises(ValueError):
        A.pseudonym(spark, F.col("a"), "short")


def test_both_joins_agree(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 50 == 0, 10).otherwise(2).alias("af"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("sa3"), (F.col("id") * 977).alias("da3"), F.col("id").alias("pos"))
    small = sorted(map(tuple, A.anonymize(df, KEY).collect()))
    large = sorted(map(tuple, A.anonymize(df, KEY, max_broadcast=0).collect()))
    assert small == large and len(small) == 490
    assert len({r[1] for r in small}) == df.filter("af = 2").select("sa3").distinct().count()


def test_special_functions():
    assert t_quantile(0.975, 4) == pytest.approx(2.7764451051978, abs=1e-10)
    assert gamma_cdf(np.array([2.0]), 3.0, 1.0)[0] == pytest.approx(1 - math.exp(-2) * 5)
    assert gamma_cdf(np.array([9.0]), 3.0, 1.0)[0] == pytest.approx(1 - math.exp(-9) * (1 + 9 + 40.5))


@pytest.mark.parametrize("c", [
    Component(1, "uniform", (0.0, 9.0)), Component(1, "norm", (50.0, 9.0)), Component(1, "lognorm", (1.0, 0.0, 20.0)),
    Component(1, "gamma", (4.0, 0.0, 6.0)), Component(1, "weibull_min", (0.8, 0.0, 60.0)), Component(1, "genpareto", (0.4, 2.0, 12.0)),
])
def test_density_sample_and_cdf_agree(spark, c):
    xs = np.linspace(0.1, 200, 2000)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    rows = df.select("x", M.component_density(c, F.col("x")).alias("d"), M.component_cdf(c, F.col("x")).alias("f")).orderBy("x").collect()
    d, f = np.array([r["d"] for r in rows]), np.array([r["f"] for r in rows])
    area = np.concatenate([[0], np.cumsum((d[1:] + d[:-1]) / 2 * np.diff(xs))])
    assert np.abs(area - (f - f[0])).max() < 0.02
    drawn = np.array([r["x"] for r in M.sample(spark, [c], 4000, x_value="duration", seed=5).collect()])
    for q in (0.25, 0.5, 0.9):
        assert M.scalar_cdf(c, np.quantile(drawn, q)) == pytest.approx(q, abs=0.03)


def recovered(spark, values, start, iterations):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    return FIT.fit(FIT.values_histogram(df, "v"), "flows", start, iterations)[1]


def test_recover_pareto_lognormal(spark):
    rng = np.random.default_rng(1)
    pareto = 12 + 30 / 1.2 * ((1 - rng.random(4000)) ** -1.2 - 1)
    mix = recovered(spark, np.concatenate([pareto, rng.lognormal(math.log(40), 4, 4000)]),
                    [Component(0.3, "genpareto", (1.2, 12, 30.0)), Component(0.7, "lognorm", (4.5, 0, 30))], 20)
    assert mix[0].weight == pytest.approx(0.5, abs=0.15)
    assert mix[0].weight + mix[1].weight == pytest.approx(1, abs=1e-9)
    assert mix[1].params[0] == pytest.approx(4, abs=0.8)


def test_recover_gamma(spark):
    rng = np.random.default_rng(2)
    mix = recovered(spark, rng.gamma(3.5, 4.0, 6000), [Component(1.0, "gamma", (2.0, 0.0, 5.0))], 60)
    assert mix[0].params[0] * mix[0].params[2] == pytest.approx(14, rel=0.03)
    assert mix[0].params[0] == pytest.approx(3.5, rel=0.1)


def test_recover_weibull(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.weibull(0.8, 4000) * 150.0, rng.weibull(1.1, 4000) * 60000.0])
    mix = recovered(spark, values, [Component(0.1, "weibull_min", (0.65, 0, 100.0)), Component(0.1, "weibull_min", (1.0, 0, 40000.0))], 12)
    assert mix[0].weight == pytest.approx(0.5, abs=0.05)
    assert mix[0].params[0] == pytest.approx(0.8, abs=0.08)
    assert mix[1].params[2] == pytest.approx(60000.0, rel=0.1)


def test_fit_over_many_tasks_equals_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = spark.createDataFrame([(float(v),) for v in np.round(rng.lognormal(3, 1, 3000)) + 1], "v double")
    start = [Component(0.5, "lognorm", (1.0, 0.0, 10.0)), Component(0.5, "weibull_min", (0.9, 0.0, 40.0))]
    seen = []
    one = FIT.fit(FIT.values_histogram(values, "v"), "flows", start, 6, callback=lambda m, mix, it: seen.append((m, it)))[1]
    monkeypatch.setattr(FIT, "BINS_PER_BLOCK", 40)
    many = FIT.fit(FIT.values_histogram(values, "v"), "flows", start, 6)[1]
    jobs = FIT.fit_many(FIT.values_histogram(values, "v"), {"flows": start}, 6, barrier=False)["flows"][1]
    assert [c.params for c in jobs] == [pytest.approx(c.params) for c in many]
    assert seen == [("flows", i) for i in range(7)]
    for a, b in zip(one, many):
        assert a.weight == pytest.approx(b.weight) and a.params == pytest.approx(b.params)
    with pytest.raises(ValueError):
        FIT.fit(FIT.values_histogram(values.limit(0), "v"), "flows", start, 2)


def test_prefixes_are_enciphered_once(spark):
    rng = random.Random(7)
    values = {rng.randrange(2**32) for _ in range(200)} | {(10 << 24) + rng.randrange(5000) for _ in range(300)} | {0, 1, 2**32 - 1, 2**31}
    df = spark.createDataFrame([(v,) for v in values], "address long")
    got = A.pseudonyms(df, KEY).collect()
    alone = dict(map(tuple, df.select("address", A.pseudonym(spark, F.col("address"), KEY)).collect()))
    assert {r["address"]: r["pseudonym"] for r in got} == alone
    assert sum(r["blocks"] for r in got) == sum(len({v >> (32 - p) for v in values}) for p in range(32))


@pytest.mark.parametrize("shape", [0.2, 0.9, 1.0, 2.5, 5.0, 300.0])
def test_gamma_quantile_equals_bisection(shape):
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.random(3000), [0.0, 1e-12, 1e-6, 1 - 1e-6, 1 - 1e-12]])
    got = M.gamma_quantile(q, shape, M.gamma_table(shape))
    low, high = np.zeros(len(q)), np.full(len(q), shape + 40 * shape**0.5 + 800.0)
    for _ in range(1100):
        mid = (low + high) / 2
        below = gamma_cdf(mid, shape, 1.0) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    assert np.abs(gamma_cdf(got, shape, 1.0) - q).max() < 1e-12
    middle = (q > 1e-9) & (q < 1 - 1e-9)
    assert np.allclose(got[middle], low[middle], rtol=1e-9, atol=0)
