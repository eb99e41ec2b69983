"""Array directories, text and result files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.schema import FIELDS, as_flows
from weirflow.sources import arrays, derived, positioned, text_flows


def make_arrays(folder, packets, octets, code="Q"):
    folder.mkdir()
    np.array(packets, "<u8").tofile(folder / f"packets.{code}")
    np.array(octets, "<u4").tofile(folder / "octets.I")
    return str(folder)


def test_arrays_across_directories(spark, tmp_path):
    a = make_arrays(tmp_path / "a", range(10), range(100, 110))
    b = make_arrays(tmp_path / "b", range(10, 15), range(110, 115))
    with pytest.warns(UserWarning):
        df = arrays.read_arrays(spark, [a, b], ["packets", "octets", "prot"], skip=8, count=4, rows_per_partition=3)
    assert sorted(map(tuple, df.select("pos", "packets", "octets", "prot").collect())) == [(i, i, 100 + i, 0) for i in range(8, 12)]
    assert arrays.read_arrays(spark, [a, b], ["packets"], skip=-1, count=0).count() == 0
    assert arrays.read_arrays(spark, [a, b], ["packets"], skip=20).count() == 0
    with pytest.raises(ValueError):
        arrays.read_arrays(spark, a, ["prot"], required=["prot"])


def test_array_errors(spark, tmp_path):
    a = make_arrays(tmp_path / "a", range(10), range(9))
    with pytest.raises(Exception, match="differ in length"):
        arrays.read_arrays(spark, a, ["packets"]).count()
    b = make_arrays(tmp_path / "b", [2**63], [1])
    with pytest.raises(Exception):
        arrays.read_arrays(spark, b, ["packets"]).collect()
    np.array([1], "<u4").tofile(tmp_path / "b" / "packets.I")
    with pytest.raises(ValueError, match="more than one"):
        arrays.read_arrays(spark, b, ["packets"])


def test_csv_with_blanks_and_bad_lines(spark, tmp_path):
    line = ", ".join(str(i) for i in range(21))
    (tmp_path / "x.csv").write_text(f"{line}\n{line}\n")
    rows = text_flows.read_csv(spark, [str(tmp_path / "x.csv")] * 2, positions=True).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == [0, 1, 2, 3]
    assert [rows[3][f] for f in FIELDS] == list(range(21))
    (tmp_path / "bad.csv").write_text(line.replace("20", "x"))
    with pytest.raises(Exception):
        text_flows.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_list_inputs(tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n in ("d/b", "d/a", "d/e/c", "z"):
        (tmp_path / n).write_text("")
    got = positioned.list_inputs([str(tmp_path / "z"), str(tmp_path / "d")])
    assert [g.removeprefix(str(tmp_path) + "/") for g in got] == ["z", "d/a", "d/b", "d/e/c"]
    with pytest.raises(FileNotFoundError):
        positioned.list_inputs([str(tmp_path / "none")])


def test_mixture_file_of_another_writer(spark, tmp_path):
    (tmp_path / "flows.json").write_text('{\n  "sum": 12,\n  "mix": [\n    [0.5, "uniform", [0, 3]],\n    [0.5, "norm", [1.5, 2]]\n  ]\n}')
    rows = derived.read_mixtures(spark, str(tmp_path)).orderBy("component").collect()
    assert [tuple(r) for r in rows] == [("flows", 12, 0, 0.5, "uniform", [0.0, 3.0]), ("flows", 12, 1, 0.5, "norm", [1.5, 2.0])]


def test_sinks(spark):
    df = spark.range(3).selectExpr("id a", "id * 2 b")
    derived.discard(df)
    assert [r[0] for r in derived.flatten(df.coalesce(1)).collect()] == [0, 0, 1, 2, 2, 4]
    assert len(list(derived.stream_rows(df))) == 3


def written_in_order(spark, df, path):
    arrays.write_arrays(df, path)
    return [r["packets"] for r in arrays.read_arrays(spark, path, ["packets"]).orderBy("pos").collect()]


def flow_rows(spark, positions, parts):
    rows = spark.range(1).selectExpr(f"explode(array({','.join(map(str, positions))})) as pos").withColumn("pos", F.col("pos").cast("long"))
    return as_flows(rows.select("*", *[F.lit(1).alias(f) for f in FIELDS if f != "packets"], F.col("pos").alias("packets"))).repartition(parts, "pos")


def test_a_table_in_order_is_written_without_an_exchange(spark, tmp_path):
    source = flow_rows(spark, range(3000), 3).orderBy("pos")
    source.drop("pos").write.parquet(str(tmp_path / "in"))
    scan = positioned.read_parquet(spark, str(tmp_path / "in"))
    assert "Exchange" not in arrays.in_order(scan)._jdf.queryExecution().executedPlan().toString()
    assert written_in_order(spark, scan, str(tmp_path / "out")) == list(range(3000))
    arrays.write_arrays(scan.filter("pos % 3 = 0"), str(tmp_path / "out"))  # appended, with holes
    assert arrays.read_arrays(spark, str(tmp_path / "out"), ["packets"]).filter("pos >= 3000").orderBy("pos").first()["packets"] == 0
    arrays.write_arrays(scan.filter("pos >= 100"), str(tmp_path / "out"), mode="overwrite")
    assert arrays.read_arrays(spark, str(tmp_path / "out"), ["packets"]).count() == 2900


def test_runs_that_overlap_are_sorted(spark, tmp_path):
    rng = random.Random(2)
    positions = rng.sample(range(5000), 700) + [9000, 9000, 9001]
    assert written_in_order(spark, flow_rows(spark, positions, 6), str(tmp_path / "a")) == sorted(positions)
    first, second = flow_rows(spark, range(50), 1), flow_rows(spark, range(100, 150), 4)
    assert written_in_order(spark, second.unionByName(first), str(tmp_path / "b")) == [*range(50), *range(100, 150)]
    assert not [n for n in (tmp_path / "b").iterdir() if n.name.startswith("_runs")]
    empty = flow_rows(spark, [1], 1).filter("pos < 0")
    assert written_in_order(spark, empty, str(tmp_path / "c")) == []


def test_overlaps():
    r = [arrays.Run("a", 5, 0, 9), arrays.Run("b", 5, 10, 19), arrays.Run("c", 2, 15, 16), arrays.Run("d", 1, 19, 25), arrays.Run("e", 0, None, None), arrays.Run("f", 1, 40, 40)]
    assert arrays.overlaps(r) == [(10, 25)]
    assert arrays.overlaps(r[:2]) == arrays.overlaps([]) == []
