"""Merging and series on unbounded flow records."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from weirflow.functions.flowcols import idiv
from weirflow.operators.series import DAY

VALUES = ["pos", "start_ms", "end_ms", "packets", "octets", "aggs"]
END_MS = 7_258_118_400_000  # the year 2200, later than any record: the time of an end mark (pandas ends in 2262)
PART_ROWS = 1024  # records of one state value
OUT_ROWS = 16_384
HELD_ROWS = 1 << 17  # of one share, after which input goes to the state
SHARES = 64
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _same(value):
    """Equal for equal key values, with a hash: NaN is itself, and nested values are tuples."""
    if isinstance(value, np.ndarray):
        value = value.tolist()
    if isinstance(value, dict):
        value = list(value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(_same, value))
    return value if value == value else "nan"


class MergeProcessor(StatefulProcessor):
    """State of one share of the keys: records by time bucket, in parts of `PART_ROWS`, and the flows that later ones may continue.

    Calls to the state are what costs, so a share has a timer only at the end of its first bucket, or where the first of
    its flows can no longer be continued. It goes through all buckets that the watermark has passed: as no earlier record
    can come, each is read, merged in time order and dropped, one at a time.
    """

    def __init__(self, keys: Sequence[str], inactive_ms: int, candidate_s: float, width_ms: int, part_rows: int):
        self.keys, self.inactive, self.candidate_s, self.width, self.part_rows = list(keys), inactive_ms, candidate_s, width_ms, part_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getValueState("flows", "flows binary")
        self.index = handle.getValueState("index", "parts binary")  # parts by bucket
        self.rows = handle.getMapState("rows", "bucket long, part long", "rows binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in rows:
            held.append(batch[[*self.keys, *VALUES]])
            n += len(batch)
            if n >= HELD_ROWS:
                self._keep(int(key[1]), held)
                held, n = [], 0
        if n:
            self._keep(int(key[1]), held)
        yield self._frame([])

    def _keep(self, nulls: int, held: list[pd.DataFrame]) -> None:
        """Add records to the parts of their buckets. In a share, a key column is null in all rows or in none."""
        values = np.concatenate([batch[VALUES].to_numpy("int64") for batch in held])
        names = [[None] * len(values) if nulls >> i & 1 else [v for batch in held for v in batch[k].tolist()] for i, k in enumerate(self.keys)]
        bucket = values[:, 1] // self.width
        order = np.argsort(bucket, kind="stable")
        order = order[values[order, 1] < END_MS]
        index = self._state(self.index)
        edges = [0, *(np.nonzero(np.diff(bucket[order]))[0] + 1).tolist(), len(order)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            b = int(bucket[order[low]])
            part = index.get(b, 0)
            for at in range(low, high, self.part_rows):
                own = order[at:min(at + self.part_rows, high)]
                self.rows.updateValue((b, part), (pickle.dumps(([[name[i] for i in own.tolist()] for name in names], values[own])),))
                part += 1
            index[b] = part
        if index:
            self.index.update((pickle.dumps(index),))
            self.handle.registerTimer((min(index) + 1) * self.width)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // self.width  # buckets before have all their records
        index, flows = self._state(self.index), self._state(self.flows)
        merged, out = sorted(b for b in index if b < passed), []
        for bucket in merged:
            for name, row in self._due(bucket, index.pop(bucket)):
                same = _same(name)
                done, flow = self._follow(flows.pop(same, (name, None))[1], row)
                out += [(*name, *x) for x in done]
                if flow is not None:
                    flows[same] = name, flow
                if len(out) >= OUT_ROWS:
                    yield self._frame(out)
                    out = []
        ended = [same for same, (_, flow) in flows.items() if flow[2] + self.inactive <= passed * self.width]
        for name, flow in map(flows.pop, ended):
            out.append((*name, *flow))
        if merged or ended:
            for state, left in ((self.index, index), (self.flows, flows)):
                if left:
                    state.update((pickle.dumps(left),))
                else:
                    state.clear()
            waits = [b + 1 for b in index] + [-(-(flow[2] + self.inactive) // self.width) for _, flow in flows.values()]
            if waits:
                self.handle.registerTimer(min(waits) * self.width)
        yield self._frame(out)

    def _state(self, state) -> dict:
        return pickle.loads(state.get()[0]) if state.exists() else {}

    def _due(self, bucket: int, parts: int) -> Iterator[tuple[tuple, tuple[int, ...]]]:
        """Keys and records of a bucket in time order; they leave the state."""
        names, read = [[] for _ in self.keys], []
        for part in range(parts):
            own, rows = pickle.loads(self.rows.getValue((bucket, part))[0])
            for name, more in zip(names, own):
                name += more
            read.append(rows)
            self.rows.removeKey((bucket, part))
        rows, names = np.concatenate(read), list(zip(*names))
        order = np.lexsort((rows[:, 0], rows[:, 2], rows[:, 1]))
        for low in range(0, len(order), OUT_ROWS):
            at = order[low:low + OUT_ROWS]
            yield from zip(map(names.__getitem__, at.tolist()), map(tuple, rows[at].tolist()))

    def _follow(self, flow: tuple | None, row: tuple) -> tuple[list[tuple], tuple | None]:
        """What is finished and what waits after the next record in time order."""
        pos, start, end, packets, octets, aggs = row
        new, done = (pos, start, end, packets, octets, aggs or 1), []
        if flow is not None:
            if start <= flow[2]:
                return [], None  # collision, both are dropped
            if start - flow[2] < self.inactive:
                new = (flow[0], flow[1], end, flow[3] + packets, flow[4] + octets, flow[5] + 1)
            else:
                done.append(flow)
        if end // 1000 - start // 1000 >= self.candidate_s:
            return done, new
        return [*done, new], None

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, *VALUES])


def merge_stream(records: DataFrame, keys: Sequence[str], inactive_s: float = 15.0, active_s: float = 300.0,
                 lateness: str = "10 minutes", bucket_s: float | None = None, shares: int = SHARES) -> DataFrame:
    """Streaming form of `merge_records`, with the same result for records that are late by `lateness` at most.

    Records wait in state by time buckets of `bucket_s` seconds (the inactive timeout by default) until the watermark has
    passed the bucket; a flow is emitted once nothing could continue it. Keys are dealt by hash into `shares`, which have
    the state and the timers, so their number follows buckets and shares and not records. What a task holds at a time is
    one bucket of one share and its unfinished flows, so choose a width and a number of shares whose records fit, keep
    both for the life of a checkpoint, and bound micro-batches at the source (`maxFilesPerTrigger`, `maxBytesPerTrigger`)
    so that the watermark moves. The end mark of `with_end` flushes what is left at the end of an
    input. Needs the RocksDB state store, which is chosen unless the session names a store.
    """
    spark = records.sparkSession
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)
    fields = [*[records.schema[k] for k in keys], *[T.StructField(v, T.LongType()) for v in VALUES]]
    width = max(1, round((inactive_s if bucket_s is None else bucket_s) * 1000))
    values = [F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in VALUES]
    # pandas would turn integers beside a null to floats: which keys are null goes with the share
    names = [F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.IntegralType) else f.name for f in fields[:len(keys)]]
    nulls = sum((F.isnull(k).cast("long") * (1 << i) for i, k in enumerate(keys)), F.lit(0).cast("long"))
    share = F.pmod(F.xxhash64(*keys), F.lit(shares))
    timed = records.select(*names, *values, F.timestamp_millis("start_ms").alias("ts"), share.alias("_share"), nulls.alias("_nulls"))
    processor = MergeProcessor(keys, round(inactive_s * 1000), active_s - inactive_s, width, PART_ROWS)
    shared = timed.withWatermark("ts", lateness).groupBy("_share", "_nulls")
    return shared.transformWithStateInPandas(processor, T.StructType(fields), "append", "eventTime")


def arrival_stream(flows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Flows started per second; a second is final, and emitted, when the watermark has passed it."""
    timed = flows.select(F.timestamp_seconds("first").alias("ts")).withWatermark("ts", lateness)
    per_second = timed.groupBy(F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("flows"))
    second = F.unix_seconds(F.col("w.start"))
    return per_second.select(idiv(second, DAY).alias("day"), (second % DAY).cast("int").alias("second"), "flows")


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """`stream` and, once `run_available` has written it under `folder`, a row of zeros at the end of time."""
    spark, path = stream.sparkSession, f"{folder}/end"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def run_available(stream: DataFrame, folder: str, end: T.StructType | None = None, at: dict[str, int] | None = None) -> DataFrame:
    """Process what is available, append it to a table under `folder`, and read that table.

    With `end`, the schema that `with_end` saw, the input is taken as finished: marks with the times `at` move the
    watermark past everything, so that nothing stays in the state: one run learns the watermark, the next fires the
    timers of the records, a last one those that these have set.
    """
    spark = stream.sparkSession

    def run() -> None:
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    if end is not None:
        zero = [f.dataType.__class__ in (T.StringType,) and "" or 0 for f in end.fields]
        row = tuple((at or {}).get(f.name, z) for f, z in zip(end.fields, zero))
        for _ in range(3):
            spark.createDataFrame([row], end).write.mode("append").parquet(f"{folder}/end")
            run()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
