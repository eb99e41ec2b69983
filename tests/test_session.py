"""Durable intermediates and their removal."""

import os

from weirflow.operators import generate as G
from weirflow.operators import occupancy as O
from weirflow.operators import positions as P
from weirflow.session import checkpoint_root, freeze, scratch


def test_scratch_deletes_what_was_frozen_inside(spark):
    kept = freeze(spark.range(5))
    before = set(os.listdir(checkpoint_root(spark)))
    with scratch(spark):
        assert freeze(spark.range(7)).count() == 7
        assert len(set(os.listdir(checkpoint_root(spark))) - before) == 1
    assert set(os.listdir(checkpoint_root(spark))) == before and kept.count() == 5


def test_dense_rank_over_holes(spark):
    rows = [(p,) for p in (0, 3, 4, 70_000, 70_001, 200_000)]
    got = P.dense_rank(spark.createDataFrame(rows, "pos long"), width=8).collect()
    assert sorted((r.pos, r["rank"]) for r in got) == [(p, i) for i, (p,) in enumerate(rows)]


def test_occupancy_has_no_end_but_that_of_the_flows(spark):
    rows = [(0, 100, 109, 5, 1000), (1, 50_100, 50_199, 5, 1000), (2, 190_100, 190_100, 5, 70)]
    flows = spark.createDataFrame(rows, "pos long, first long, last long, packets long, octets long")
    got = {r.second: (r.flows, r.octets) for r in O.occupancy(flows, timeout=10).collect()}
    assert max(got) == 190_000 + 1 + 10 - 1 and len(got) == 190_011
    assert got[0] == (1, 100.0) and got[19] == (1, 0.0) and got[20] == (0, 0.0)
    assert got[50_000] == (1, 10.0) and got[50_109] == (1, 0.0) and got[190_000] == (1, 70.0)
    holes = flows.filter("pos <> 1")
    by_order = {r.second: r.flows for r in O.occupancy(holes, pps=5, fps=1, timeout=1).collect()}
    assert by_order == {0: 1, 1: 2, 2: 2, 3: 1}
    assert O.occupancy(flows.limit(0)).count() == 0


def test_empty_bins_generate_nothing(spark):
    bins = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 6, 600)], "bin_lo long, flows_sum long, packets_sum long, octets_sum long")
    assert G.expand_histogram(bins).count() == 3
    assert G.sample_histogram(bins, 20).filter("packets = 2").count() == 20
    assert G.sample_histogram(bins.limit(0), 20).count() == 0
