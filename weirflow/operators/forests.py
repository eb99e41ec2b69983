"""Regression forests over inputs of one byte each, grown and cut for a whole grid of depths, leaf sizes and tree numbers.

What a node does depends only on its place in its tree: its inputs are drawn by a hash of the seed, the tree and the path
to it. So a tree of lesser depth is the upper part of the deepest one, a forest of fewer trees is the first of its trees,
and only leaf sizes need trees of their own. Bags are Poisson counts by a hash of the position.

One task grows the trees of one bag. It keeps the bag's inputs as bytes, and takes the nodes of a level in stretches.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.features import feature_array
from weirflow.session import freeze
from weirflow.shipping import PIECES, loads, pieces

KINDS = ("bytes", "bits")  # kinds of features with values of one byte
LEAF = 255
STRETCH = 1 << 18  # rows of a level that are looked at together
DENSE = 64  # rows per node from which bins are counted instead of sorted
DENSE_NODES = 1 << 11
BINS = 256
_GAMMA, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _drawn(key: int, paths: np.ndarray, inputs: int) -> np.ndarray:
    """A third of the inputs for each node, as Spark's forests draw them."""
    take = math.ceil(inputs / 3)
    own = _mix(paths + np.array(key, np.uint64) * _GAMMA)
    z = _mix(own[:, None] + np.arange(1, inputs + 1, dtype=np.uint64) * _GAMMA)
    return np.sort(np.argpartition(z, take - 1, axis=1)[:, :take], axis=1)


def _gain(wl, sl, w, mean, leaf):
    """By how much a split lessens the squared error; below 0 where it leaves a side too small."""
    wr, d = w - wl, sl - wl * mean
    ok = (wl >= leaf) & (wr >= leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ok, d * d * w / (wl * wr), -1.0)


def _counted(bins, nd, w, wy, weight, mean, leaf):
    """Best gain and threshold per node for one input of each, from counts of every bin."""
    nodes, key = len(weight), nd * BINS + bins
    cw = np.bincount(key, w, nodes * BINS).reshape(nodes, BINS)
    wl, sl = np.cumsum(cw, axis=1)[:, :-1], np.cumsum(np.bincount(key, wy, nodes * BINS).reshape(nodes, BINS), axis=1)[:, :-1]
    gain = _gain(wl, sl, weight[:, None], mean[:, None], leaf)
    at = np.argmax(gain, axis=1)
    following = np.argmax((cw > 0) & (np.arange(BINS) > at[:, None]), axis=1)
    return gain[np.arange(nodes), at], (at + following) // 2


def _sorted(bins, nd, w, wy, weight, mean, leaf, starts):
    """The same from rows sorted by node and bin, for nodes of few rows."""
    key = np.sort(((nd * BINS + bins) << 32) | np.arange(len(nd)))
    row, place = key & 0xFFFFFFFF, key >> 32
    cw, cs = np.cumsum(w[row]), np.cumsum(wy[row])
    before_w, before_s = (np.where(starts > 0, c[starts - 1], 0) for c in (cw, cs))
    gain = _gain(cw - before_w[nd], cs - before_s[nd], weight[nd], mean[nd], leaf)  # rows come sorted by node
    gain[:-1][place[:-1] == place[1:]] = -1.0
    best = np.maximum.reduceat(gain, starts)
    at = np.flatnonzero((gain == best[nd]) & (gain >= 0))
    at = at[np.r_[True, nd[at][1:] != nd[at][:-1]]] if len(at) else at
    threshold = np.zeros(len(starts), np.int64)
    threshold[nd[at]] = ((place[at] & 255) + (place[np.minimum(at + 1, len(place) - 1)] & 255)) // 2
    return best, threshold


def _splits(x, rows, nd, w, wy, feats, weight, mean, leaf, starts):
    """Input, threshold and gain of the best split of each node."""
    gain = np.zeros(len(weight))
    feature, threshold = np.full(len(weight), LEAF, np.uint8), np.zeros(len(weight), np.uint8)
    few = len(rows) < DENSE * len(weight)
    for j in range(feats.shape[1]):
        bins = x[rows, feats[nd, j]].astype(np.int64)
        found = (bins, nd, w, wy, weight, mean, leaf)
        g, t = _sorted(*found, starts) if few else _counted(*found)
        better = g > gain
        gain[better], feature[better], threshold[better] = g[better], feats[better, j], t[better]
    return feature, threshold


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, leaf: int, depth: int, key: int) -> tuple[np.ndarray, ...]:
    """A tree over rows of bytes `x`: input (`LEAF`: none), threshold, left child (the right one follows) and mean of each node.

    `leaf` is the least weight of a side. Nodes are in order of depth, so that the tree can be cut at any depth.
    """
    rows, nd, paths = np.arange(len(y), dtype=np.int32), np.zeros(len(y), np.int64), np.ones(1, np.uint64)
    out: list[tuple[np.ndarray, ...]] = []
    total = 0
    for level in range(depth + 1):
        starts = np.flatnonzero(np.r_[True, nd[1:] != nd[:-1]])
        wr = w[rows].astype(np.float64)
        wy = wr * y[rows]
        weight, mean = np.add.reduceat(wr, starts), np.add.reduceat(wy, starts)
        mean = mean / weight
        nodes = len(starts)
        feature, threshold = np.full(nodes, LEAF, np.uint8), np.zeros(nodes, np.uint8)
        if level < depth:
            ends, a = np.r_[starts[1:], len(rows)], 0
            while a < nodes:
                b = min(max(a + 1, int(np.searchsorted(ends, starts[a] + STRETCH, "right"))), a + DENSE_NODES * 8)
                if ends[b - 1] - starts[a] >= DENSE * (b - a):
                    b = min(b, a + DENSE_NODES)
                at = slice(starts[a], ends[b - 1])
                feature[a:b], threshold[a:b] = _splits(
                    x, rows[at], nd[at] - a, wr[at], wy[at], _drawn(key, paths[a:b], x.shape[1]), weight[a:b], mean[a:b], leaf, starts[a:b] - starts[a])
                a = b
        split = feature != LEAF
        rank = np.cumsum(split) - 1
        left = np.where(split, total + nodes + 2 * rank, 0).astype(np.int32)
        out.append((feature, threshold, left, mean))
        total += nodes
        if not split.any():
            break
        stay = split[nd]
        rows, nd = rows[stay], nd[stay]
        right = x[rows, feature[nd]] > threshold[nd]
        order = np.sort(((2 * rank[nd] + right) << 32) | np.arange(len(rows)))
        rows, nd = rows[order & 0xFFFFFFFF], order >> 32
        paths = np.repeat(paths[split] * np.uint64(2), 2)
        paths[1::2] += np.uint64(1)
    return tuple(np.concatenate(part) for part in zip(*out))


def means_at(tree: tuple[np.ndarray, ...], x: np.ndarray, depths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """`(place in depths, mean of each row's node)` of the tree cut at each depth."""
    feature, threshold, left, mean = tree
    at, live = np.zeros(len(x), np.int32), np.arange(len(x))
    for level in range(max(depths) + 1):
        if level and len(live):
            node = at[live]
            inner = feature[node] != LEAF
            live, node = live[inner], node[inner]
            at[live] = left[node] + (x[live, feature[node]] > threshold[node])
        if level in depths:
            found = mean[at]
            yield from ((i, found) for i, d in enumerate(depths) if d == level)


def _bytes(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten()
    if values.null_count:
        raise ValueError("an input of a flow is null")
    return values.to_numpy().astype(np.uint8).reshape(rows, -1)


def _times(seed: int, pos: Column, tree: Column) -> Column:
    """How often a flow is in the bag of a tree: Poisson of mean 1."""
    u = F.pmod(F.xxhash64(F.lit(seed), pos, tree), F.lit(1 << 52)) / F.lit(float(1 << 52))
    reached = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(15)]
    return sum((u >= F.lit(c)).cast("int") for c in reached)


def grow_forest(train: DataFrame, kind: str, trees: int, depth: int, leaves: Sequence[int], seed: int, pos: str) -> DataFrame:
    """Trees of every leaf size on bags of the flows, as rows of `PIECES`. Null inputs and sizes are errors."""
    every = train.select(
        F.col(pos).alias("pos"), feature_array(kind).cast("array<smallint>").alias("x"), F.col("octets").cast("double").alias("y"),
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    bags = every.select("tree", "x", "y", _times(seed, F.col("pos"), F.col("tree")).alias("times")).filter("times > 0")

    def grown(bag: pa.Table) -> pa.Table:
        if bag["y"].null_count:
            raise ValueError("the size of a flow to train on is null")
        tree, y, w = bag["tree"][0].as_py(), bag["y"].to_numpy(), bag["times"].to_numpy().astype(np.uint8)
        x = _bytes(bag["x"], len(y))
        rows = [pieces(tree * len(leaves) + i, pickle.dumps((tree, i, grow(x, y, w, leaf, depth, seed * 1_000_003 + tree)), protocol=5))
                for i, leaf in enumerate(leaves)]
        return pa.Table.from_pandas(pd.concat(rows), preserve_index=False, schema=pa.schema([("id", pa.int64()), ("seq", pa.int32()), ("data", pa.binary())]))

    return freeze(bags.repartitionByRange(trees, "tree").groupBy("tree").applyInArrow(grown, PIECES))


def _added(load: Broadcast, trees: Sequence[int], depths: Sequence[int], leaves: int,
           grown: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: list = []
        for batch in batches:
            forest = forest or [pickle.loads(blob) for blob in load.value]
            if not batch.num_rows:
                continue
            x = _bytes(batch["x"], batch.num_rows)
            shape = (batch.num_rows, len(trees), len(depths), leaves)
            sums = batch["predictions"].flatten().to_numpy().reshape(shape).copy() if "predictions" in batch.schema.names else np.zeros(shape)
            for tree, leaf, nodes in forest:
                within = [i for i, t in enumerate(trees) if tree < t]
                for d, mean in means_at(nodes, x, depths):
                    for i in within:
                        sums[:, i, d, leaf] += mean / grown[trees[i]]
            width = sums[0].size
            told = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width, dtype=np.int32)), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["octets"], batch["x"], told], ["octets", "x", "predictions"])

    return run


def grid_predictions(test: DataFrame, kind: str, forest: DataFrame, trees: Sequence[int], depths: Sequence[int],
                     leaves: int) -> tuple[DataFrame, Callable[[], None]]:
    """`octets, predictions` of every flow: the mean over its trees for each (trees, depth, leaf) in order of their product.

    Trees are broadcast a load at a time and added to the flow's means; means are written between loads. The frame is
    computed once per use, so use it once; the function that comes with it gives the last load back.
    """
    spark = test.sparkSession
    there = {r["id"] // leaves for r in forest.select("id").distinct().collect()}  # a bag of few flows may be empty
    grown = {t: sum(tree < t for tree in there) for t in trees}
    out, shipped = test.select("octets", feature_array(kind).cast("array<smallint>").alias("x")), None
    for load in loads(forest):
        if shipped is not None:
            out = freeze(out)
            shipped.destroy()
        shipped = spark.sparkContext.broadcast(load)
        out = out.mapInArrow(_added(shipped, trees, depths, leaves, grown), "octets long, x array<smallint>, predictions array<double>")
    if shipped is None:
        return out.select("octets", F.lit(None).cast("array<double>").alias("predictions")), lambda: None
    return out.select("octets", "predictions"), shipped.destroy
