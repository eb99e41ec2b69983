"""Forests of a grid against trees split one value at a time, and against forests grown for one grid point."""

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow import shipping
from weirflow.operators import forests
from weirflow.operators import learning as L
from weirflow.plans import learning_queries


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    rows = [(pos, rng.randrange(1024, 60000), 10 + pos % 7, 99 + pos % 5, rng.choice([80, 443, 53]), 6, 100 * rng.randrange(1, 2000)) for pos in range(300)]
    return spark.createDataFrame(rows, "pos long, sp int, sa3 long, da3 long, dp int, prot int, octets long").cache()


def slow(x, y, w, leaf, depth, key, path=1, level=0):
    """`{path: (mean, input, threshold)}` of a tree that tries every value."""
    total, whole, best = w.sum(), (w * y).sum(), (0, None, None)
    if level < depth:
        for j in forests._drawn(key, np.array([path], np.uint64), x.shape[1])[0]:
            values = np.unique(x[:, j])
            for low, high in zip(values[:-1], values[1:]):
                at = x[:, j] <= low
                wl, sl = w[at].sum(), (w * y)[at].sum()
                if wl >= leaf and total - wl >= leaf:
                    gain = (sl - wl * (whole / total)) ** 2 * total / (wl * (total - wl))
                    if gain > best[0]:
                        best = (gain, int(j), (int(low) + int(high)) // 2)
    out = {path: (whole / total, *best[1:])}
    if best[1] is not None:
        at = x[:, best[1]] <= best[2]
        for side, m in enumerate((at, ~at)):
            out.update(slow(x[m], y[m], w[m], leaf, depth, key, 2 * path + side, level + 1))
    return out


@pytest.mark.parametrize("stretch,dense", [(1 << 18, 64), (50, 64), (60, 10**9), (1 << 18, 0)])
def test_trees_equal_trying_every_value(monkeypatch, stretch, dense):
    monkeypatch.setattr(forests, "STRETCH", stretch)
    monkeypatch.setattr(forests, "DENSE", dense)
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (300, 7)).astype(np.uint8)
    x[:, 2] //= 64
    x[:, 3] = 5
    y, w = np.round(np.exp(r.normal(size=300) * 2) * 100) + x[:, 1] * 10.0, r.integers(1, 4, 300).astype(np.uint8)
    for leaf in (1, 3):
        tree = feature, threshold, left, mean = forests.grow(x, y, w, leaf, 6, 77)
        want = slow(x, y, w.astype(float), leaf, 6, 77)
        got, todo = {}, [(0, 1)]
        while todo:
            i, path = todo.pop()
            inner = feature[i] != forests.LEAF
            got[path] = (pytest.approx(mean[i]), int(feature[i]) if inner else None, int(threshold[i]) if inner else None)
            todo += [(left[i], 2 * path), (left[i] + 1, 2 * path + 1)] if inner else []
        assert got == want and max(got) > 63
        cut = forests.grow(x, y, w, leaf, 3, 77)
        assert np.array_equal(dict(forests.means_at(tree, x, [3, 6]))[0], dict(forests.means_at(cut, x, [3]))[0])


def test_each_grid_point_equals_a_forest_of_its_own(spark, table, monkeypatch):
    shipped = []

    def few(kept):
        for load in shipping.loads(kept, 4_000):
            shipped.append(len(load))
            yield load

    def predicted(trees, depths, leaves):
        grown = forests.grow_forest(table, "bytes", max(trees), max(depths), leaves, 3, "pos")
        out, done = forests.grid_predictions(table, "bytes", grown, trees, depths, len(leaves))
        rows = np.array([r["predictions"] for r in out.orderBy(F.col("octets").asc_nulls_first(), F.hash("x")).collect()])
        done()
        return rows

    grid = [(t, d, leaf) for t in (2, 6) for d in (2, 9) for leaf in (1, 4)]
    alone = {point: predicted([point[0]], [point[1]], [point[2]])[:, 0] for point in (grid[1], grid[6])}
    monkeypatch.setattr(forests, "loads", few)
    together = predicted([2, 6], [2, 9], [1, 4])
    assert together.shape == (300, 8) and len(shipped) > 1 and sum(shipped) == 12
    for point, own in alone.items():
        assert together[:, grid.index(point)] == pytest.approx(own)
    assert len(np.unique(together[:, 7])) > len(np.unique(together[:, 0]))


def test_bags_are_poisson_and_forests_learn(spark, table):
    times = spark.range(20_000).select(forests._times(1, F.col("id"), F.lit(2)).alias("n")).groupBy("n").count().collect()
    share = {r["n"]: r["count"] / 20_000 for r in times}
    assert [share[k] for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.015)
    known = table.withColumn("octets", F.when(F.col("dp") == 443, 50_000).otherwise(F.col("octets") % 900))
    out, done = forests.grid_predictions(known, "bytes", forests.grow_forest(known, "bytes", 20, 6, [1], 1, "pos"), [20], [6], 1)
    told = [(r["octets"], r["predictions"][0]) for r in out.collect()]
    done()
    assert np.mean([(o - p) ** 2 for o, p in told]) < np.var([o for o, _ in told]) / 20


@pytest.mark.parametrize("column", ["sp", "octets"])
def test_null_inputs_and_sizes_are_errors(table, column):
    with pytest.raises(Exception, match="null"):
        forests.grow_forest(table.withColumn(column, F.expr(f"if(pos < 50, null, {column})")), "bytes", 2, 2, [1], 0, "pos")


def test_the_query_asks_for_the_whole_grid(spark, table, monkeypatch):
    asked, signature = [], inspect.signature(L.tune)

    def tune(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return table

    monkeypatch.setattr(learning_queries, "flows", lambda session, folder: table)
    monkeypatch.setattr(L, "tune", tune)
    learning_queries.tune_regressor(spark, "nowhere")
    told = asked[0]
    assert (list(told["trees"]), list(told["depths"]), list(told["leaves"]), told["folds"]) == ([23], list(range(20, 31)), [1, 2, 3, 4], 5)
