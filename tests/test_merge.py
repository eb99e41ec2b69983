"""Merging against a record-by-record state machine."""

import random

import pytest

from weirflow.operators import merge as M
from weirflow.streaming import flows as ST

SCHEMA = "k int, pos long, start_ms long, end_ms long, packets long, octets long, aggs long"
INACTIVE, ACTIVE = 15, 60


def machine(rows):
    """Time-ordered state machine over one list of records, all keys."""
    waiting, out, wrong, merged = {}, [], 0, 0
    for k, pos, start, end, pk, oc, aggs in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        long = end // 1000 - start // 1000 >= ACTIVE - INACTIVE
        new = [k, pos, start, end, pk, oc, aggs or 1]
        old = waiting.pop(k, None)
        if old is not None:
            if start <= old[3]:
                wrong += 1
                continue
            if start - old[3] < INACTIVE * 1000:
                merged += 1
                new = [k, old[1], old[2], end, old[4] + pk, old[5] + oc, old[6] + 1]
            else:
                out.append(old)
        if long:
            waiting[k] = new
        else:
            out.append(new)
    out += waiting.values()
    return sorted(map(tuple, out)), wrong, merged


def random_rows(n, keys, seed):
    rng = random.Random(seed)
    clock = [0] * keys
    rows = []
    for pos in range(n):
        k = rng.randrange(keys)
        gap = rng.choice([-20_000, -1, 0, 1, 5_000, 14_999, 15_000, 15_001, 40_000])
        start = max(0, clock[k] + gap)
        end = start + rng.choice([0, 10_000, 44_999, 45_000, 45_000, 60_000, 60_000])
        clock[k] = end
        rows.append((k, pos, start, end, rng.randrange(1, 9), rng.randrange(64, 999), rng.choice([0, 0, 3])))
    return rows


def collected(df):
    return sorted(tuple(r) for r in df.select("k", "pos", "start_ms", "end_ms", "packets", "octets", "aggs").collect())


@pytest.mark.parametrize("hot_rows", [None, 5_000_000, 40])
def test_random_records(spark, hot_rows):
    rows = random_rows(1500, 40, 3) + [(99, *r[1:]) for r in random_rows(1500, 1, 4)]
    rows = [(k, i, *rest) for i, (k, _, *rest) in enumerate(rows)]
    want, wrong, merged = machine(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(M.merge_records(df, ["k"], INACTIVE, ACTIVE, hot_rows)) == want
    stats = M.merge_stats(df, ["k"], INACTIVE, ACTIVE, hot_rows).first()
    assert (stats["wrong"], stats["merged"], stats["written"]) == (wrong, merged, len(want))


def test_long_collision_chain_across_chunks(spark):
    rows = [(1, i, i * 1000, i * 1000 + 50_000, 1, 64, 0) for i in range(301)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, *_ = machine(rows)
    assert collected(M.merge_records(df, ["k"], INACTIVE, ACTIVE, hot_rows=20)) == want
    chain = [(1, i, i * 60_000, i * 60_000 + 50_000, 2, 70, 0) for i in range(200)]
    df = spark.createDataFrame(chain, SCHEMA)
    assert collected(M.merge_records(df, ["k"], INACTIVE, ACTIVE, hot_rows=20)) == [(1, 0, 0, 199 * 60_000 + 50_000, 400, 14_000, 200)]


def test_edges(spark):
    rows = [
        (1, 0, 0, 50_000, 1, 100, 0), (1, 1, 50_000, 99_000, 1, 100, 0),  # touching records collide
        (2, 2, 0, 50_000, 1, 100, 3), (2, 3, 64_999, 70_000, 2, 200, 0),  # just inside the inactive timeout
        (3, 4, 0, 50_000, 1, 100, 0), (3, 5, 65_000, 70_000, 2, 200, 0),  # just outside
        (4, 6, 0, 10_000, 1, 100, 0), (4, 7, 11_000, 12_000, 2, 200, 0),  # too short to be continued
    ]
    got = collected(M.merge_records(spark.createDataFrame(rows, SCHEMA), ["k"], INACTIVE, ACTIVE))
    assert got == [(2, 2, 0, 70_000, 3, 300, 4), (3, 4, 0, 50_000, 1, 100, 1), (3, 5, 65_000, 70_000, 2, 200, 1),
                   (4, 6, 0, 10_000, 1, 100, 1), (4, 7, 11_000, 12_000, 2, 200, 1)]


def test_stream_equals_batch(spark, tmp_path):
    day = 86_400_000  # the first watermark is the epoch
    rows = [(k, pos, s + day, e + day, *rest) for k, pos, s, e, *rest in random_rows(600, 30, 9)]
    batch = spark.createDataFrame(rows, SCHEMA)
    want = collected(M.merge_records(batch, ["k"], INACTIVE, ACTIVE))
    # six files, one per micro-batch, each with records out of order that are late by no more than the lateness
    rng = random.Random(4)
    span = max(r[2] for r in rows) - min(r[2] for r in rows)
    rows.sort(key=lambda r: r[2] + rng.uniform(0, span / 4))
    for n in range(6):
        part = rows[n * len(rows) // 6:(n + 1) * len(rows) // 6]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merged = ST.merge_stream(ST.with_end(stream, str(tmp_path)), ["k"], INACTIVE, ACTIVE, f"{span // 4 + 1000} milliseconds")
    got = ST.run_available(merged, str(tmp_path), stream.schema, {"start_ms": ST.END_MS, "end_ms": ST.END_MS})
    assert collected(got) == want


def test_one_hot_key_waits_in_small_parts_and_late_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "PART_ROWS", 7)
    day = 86_400_000
    rows = [(1, pos, s + day, e + day, *rest) for _, pos, s, e, *rest in random_rows(500, 1, 5)]
    rows += [(k, 1000 + pos, s + day, e + day, *rest) for k, pos, s, e, *rest in random_rows(60, 3, 6)]
    rows = list({r[1]: r for r in rows}.values())
    batch = spark.createDataFrame(rows, SCHEMA)
    want = collected(M.merge_records(batch, ["k"], INACTIVE, ACTIVE))
    rng = random.Random(1)
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 120_000))
    for n in range(3):
        spark.createDataFrame(rows[n::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    span = max(r[2] for r in rows) - min(r[2] for r in rows)
    for name, bucket in (("a", 1.0), ("b", 600.0), ("c", None)):
        folder = str(tmp_path / name)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        merged = ST.merge_stream(ST.with_end(stream, folder), ["k"], INACTIVE, ACTIVE, f"{span + 200_000} milliseconds", bucket)
        got = ST.run_available(merged, folder, stream.schema, {"start_ms": ST.END_MS, "end_ms": ST.END_MS})
        assert collected(got) == want


def test_timers_follow_buckets_and_shares_not_keys(spark, tmp_path):
    day, schema = 86_400_000, SCHEMA.replace("k int", "k long")
    rows = [(k + 2**60 if k % 50 else None, pos, s + day, e + day, *rest) for k, pos, s, e, *rest in random_rows(3000, 400, 3)]  # not exact in a float
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(map(str, M.merge_records(spark.createDataFrame(rows, schema), ["k"], INACTIVE, ACTIVE).select(*schema.replace(" long", "").split(", ")).collect()))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    merged = ST.merge_stream(ST.with_end(stream, str(tmp_path)), ["k"], INACTIVE, ACTIVE, bucket_s=600.0)
    got = ST.run_available(merged, str(tmp_path), stream.schema, {"start_ms": ST.END_MS, "end_ms": ST.END_MS})
    assert sorted(map(str, got.collect())) == want
    again = merged.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "noop")).trigger(availableNow=True).start()
    again.awaitTermination()
    timers = sum(int(o["customMetrics"].get("numRegisteredTimers", 0)) for p in again.recentProgress for o in p["stateOperators"])
    assert 0 < timers <= 2 * ST.SHARES < len({r[0] for r in rows})
