"""Directories with one raw little-endian array file per flow field, as a Spark data source.

`packets.Q` holds the packets of all rows as unsigned 64-bit integers, and so on. A directory is either such a set
of files or what the sink writes: sub-directories of that kind, listed in order in a manifest. The path must be
mounted on every executor and on the driver, which keeps the manifest.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from weirflow.schema import FIELD_CODES, FIELDS, FLOW_SCHEMA

# Storage types by file suffix
DTYPES = {"B": "<u1", "H": "<u2", "I": "<u4", "Q": "<u8"}
MANIFEST = "_parts.json"
ROWS_PER_PARTITION = 4_000_000
ROWS_PER_BATCH = 65_536
READ_SCHEMA = T.StructType([*FLOW_SCHEMA.fields, T.StructField("pos", T.LongType())])


def find_array(directory: str, field: str) -> str | None:
    """File of a field; None when there is none, an error when there are several."""
    names = [n for n in os.listdir(directory) if n.rsplit(".", 1)[0] == field and n.rsplit(".", 1)[-1] in DTYPES]
    if len(names) > 1:
        raise ValueError(f"more than one array for field {field} in {directory}: {sorted(names)}")
    return os.path.join(directory, names[0]) if names else None


def rows_in(directory: str) -> int:
    """Rows of a directory; all its arrays must agree."""
    sizes = {}
    for name in os.listdir(directory):
        code = name.rsplit(".", 1)[-1]
        if code in DTYPES:
            length, rest = divmod(os.path.getsize(os.path.join(directory, name)), np.dtype(DTYPES[code]).itemsize)
            if rest:
                raise ValueError(f"{name} in {directory} is cut off")
            sizes[name] = length
    if len(set(sizes.values())) > 1:
        raise ValueError(f"arrays in {directory} differ in length: {sizes}")
    return next(iter(sizes.values()), 0)


def leaf_directories(path: str) -> list[str]:
    manifest = os.path.join(path, MANIFEST)
    if os.path.exists(manifest):
        with open(manifest) as f:
            return [os.path.join(path, p) for p in json.load(f)]
    return [path]


@dataclass
class RowRange(InputPartition):
    directory: str
    start: int
    count: int
    pos: int


class ArrayReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.paths = json.loads(options["paths"])
        self.skip = max(int(options.get("skip", 0)), 0)
        self.count = int(options["count"]) if "count" in options else None
        self.step = int(options.get("rowsperpartition", ROWS_PER_PARTITION))

    def partitions(self) -> Sequence[RowRange]:
        """Row ranges of the slice; directories outside of it are not opened by any task."""
        stop = None if self.count is None else self.skip + max(self.count, 0)
        out, base = [], 0
        for path in self.paths:
            for directory in leaf_directories(path):
                rows = rows_in(directory)
                low = max(self.skip - base, 0)
                high = rows if stop is None else min(rows, stop - base)
                out += [RowRange(directory, s, min(self.step, high - s), base + s) for s in range(low, high, self.step)]
                base += rows
        return out or [RowRange(self.paths[0], 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        files = {f: find_array(partition.directory, f) for f in self.schema.names if f != "pos"} if partition.count else {}
        for start in range(0, partition.count, ROWS_PER_BATCH):
            n = min(ROWS_PER_BATCH, partition.count - start)
            row = partition.start + start
            columns = []
            for field in target:
                if field.name == "pos":
                    values = np.arange(n, dtype="i8") + (partition.pos + start)
                elif files[field.name] is None:
                    values = np.zeros(n, "i8")
                else:
                    dtype = np.dtype(DTYPES[files[field.name].rsplit(".", 1)[-1]])
                    values = np.fromfile(files[field.name], dtype, n, offset=row * dtype.itemsize)
                columns.append(pa.array(values).cast(field.type))  # the cast rejects counters of 2^63 and more
            yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    directory: str
    rows: int
    first: int | None  # least and greatest position, if the rows have positions; a partition's rows are in order
    last: int | None


class ArrayWriter(DataSourceArrowWriter):
    """Every task attempt fills a directory of its own; only committed ones enter the manifest.

    With the option `staged`, a name, the committed runs are listed under that name instead, for `write_arrays`, which
    puts them in order.
    """

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.names = schema.names
        self.path = json.loads(options["paths"])[0]
        self.staged = options.get("staged")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex[:8]}"
        directory = os.path.join(self.path, name)
        os.makedirs(directory)
        fields = [f for f in FIELDS if f in self.names]
        files = {f: open(os.path.join(directory, f"{f}.{FIELD_CODES[f]}"), "wb") for f in fields}
        rows, first, last = 0, None, None
        try:
            for batch in iterator:
                if "pos" in self.names and batch.num_rows:
                    pos = batch.column(self.names.index("pos")).to_numpy(zero_copy_only=False)
                    if (np.diff(pos) < 0).any() or (last is not None and pos[0] < last):
                        raise ValueError("rows of a partition must be in the order of pos")
                    first, last = int(pos[0]) if first is None else first, int(pos[-1])
                rows += batch.num_rows
                for f in fields:
                    values = batch.column(self.names.index(f)).to_numpy(zero_copy_only=False)
                    dtype = np.dtype(DTYPES[FIELD_CODES[f]])
                    if len(values) and (values.min() < 0 or int(values.max()) > np.iinfo(dtype).max):
                        raise ValueError(f"{f} does not fit into its array type")
                    values.astype(dtype).tofile(files[f])
        finally:
            for f in files.values():
                f.close()
        return Written(number, name, rows, first, last)

    def commit(self, messages: list[Written | None]) -> None:
        written = sorted((m for m in messages if m), key=lambda m: m.partition)
        os.makedirs(self.path, exist_ok=True)
        if self.staged:
            _store(self.path, self.staged, [[m.directory, m.rows, m.first, m.last] for m in written])
        else:
            _list_parts(self.path, [m.directory for m in written], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                shutil.rmtree(os.path.join(self.path, m.directory), ignore_errors=True)


def _store(path: str, name: str, value: list) -> None:
    """Write a JSON file in one step."""
    temporary = os.path.join(path, name + ".new")
    with open(temporary, "w") as f:
        json.dump(value, f)
    os.replace(temporary, os.path.join(path, name))


def _list_parts(path: str, new: list[str], overwrite: bool) -> None:
    listed = os.path.exists(os.path.join(path, MANIFEST))
    old = [os.path.basename(p) for p in leaf_directories(path)] if listed and not overwrite else []
    _store(path, MANIFEST, old + new)


class FlowArrays(DataSource):
    """`spark.read.format("flow_arrays")`; the requested schema decides which files are opened."""

    @classmethod
    def name(cls) -> str:
        return "flow_arrays"

    def schema(self) -> T.StructType:
        return READ_SCHEMA

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(schema, dict(self.options), overwrite)


def read_arrays(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str] | None = None, skip: int = 0,
                count: int | None = None, required: Sequence[str] = (), rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Rows of array directories in list order, with `pos`.

    `fields` limits the files that are opened, `skip` and `count` the rows. A field without a file reads as 0 with a
    warning; name the fields a filter uses in `required` to make that an error.
    """
    inputs = [paths] if isinstance(paths, str) else list(paths)
    wanted = [*(fields or FIELDS)]
    for path in inputs:
        for directory in leaf_directories(path):
            for f in wanted:
                if find_array(directory, f) is None:
                    if f in required:
                        raise ValueError(f"field {f} is needed but has no array in {directory}")
                    warnings.warn(f"no array for field {f} in {directory}, reading zeros", stacklevel=2)
    spark.dataSource.register(FlowArrays)
    schema = T.StructType([READ_SCHEMA[f] for f in [*wanted, "pos"]])
    reader = spark.read.format("flow_arrays").schema(schema).option("paths", json.dumps(inputs))
    reader = reader.option("skip", str(skip or 0)).option("rowsperpartition", str(rows_per_partition))
    if count is not None:
        reader = reader.option("count", str(count))
    return reader.load()


@dataclass
class Run:
    """One written directory: its rows and their least and greatest position."""

    directory: str
    rows: int
    first: int | None
    last: int | None


def overlaps(runs: Sequence[Run]) -> list[tuple[int, int]]:
    """Ranges of positions, ascending and apart, in which runs overlap; the other runs have an order of their own."""
    out: list[tuple[int, int]] = []
    low, high, members = 0, -1, 0
    for r in sorted((r for r in runs if r.rows), key=lambda r: r.first):
        if members and r.first <= high:
            high, members = max(high, r.last), members + 1
            continue
        if members > 1:
            out.append((low, high))
        low, high, members = r.first, r.last, 1
    return [*out, (low, high)] if members > 1 else out


MOST_RANGES = 64


def in_order(flows: DataFrame) -> DataFrame:
    """Rows sorted inside their partitions only: what a scan reads in order stays where it is."""
    return flows.select(*FIELDS, "pos").sortWithinPartitions("pos")


def write_arrays(flows: DataFrame, path: str, mode: str = "append") -> None:
    """Write a flow table in `pos` order (or as it is partitioned, without `pos`).

    Each task writes its rows as one run and tells its first and last position; the manifest lists the runs in that
    order. Only positions that several runs share are written again, from a range exchange over just these rows, so a
    table in the order of its files is written without an exchange. Rows with equal `pos` stay in one piece of order.
    """
    spark = flows.sparkSession
    spark.dataSource.register(FlowArrays)

    def save(rows: DataFrame, staged: str | None, how: str) -> None:
        writer = rows.write.format("flow_arrays").option("paths", json.dumps([path])).mode(how)
        (writer.option("staged", staged) if staged else writer).save()

    if "pos" not in flows.columns:
        save(flows.select(*FIELDS), None, mode)
        return

    def written(rows: DataFrame) -> list[Run]:
        name = f"_runs-{uuid.uuid4().hex}.json"
        save(rows, name, "append")
        with open(os.path.join(path, name)) as f:
            runs = [Run(*x) for x in json.load(f)]
        os.remove(os.path.join(path, name))
        return runs

    runs = written(in_order(flows))
    shared = overlaps(runs)
    if len(shared) > MOST_RANGES:
        shared = [(shared[0][0], shared[-1][1])]
    if shared:
        pos = F.col("pos")
        again = reduce(lambda a, b: a | b, [(pos >= low) & (pos <= high) for low, high in shared])
        gone = [r for r in runs if r.rows and any(low <= r.first and r.last <= high for low, high in shared)]
        runs = [r for r in runs if r not in gone] + written(flows.filter(again).select(*FIELDS, "pos").orderBy("pos"))
        for r in gone:
            shutil.rmtree(os.path.join(path, r.directory), ignore_errors=True)
    _list_parts(path, [r.directory for r in sorted((r for r in runs if r.rows), key=lambda r: r.first)], mode == "overwrite")
    for r in runs:
        if not r.rows:
            shutil.rmtree(os.path.join(path, r.directory), ignore_errors=True)
