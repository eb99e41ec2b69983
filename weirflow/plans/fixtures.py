"""Flow tables derived from the given tables, as Spark plans and as the same SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.schema import as_flows
from weirflow.sources.positioned import read_parquet

_PACKETS = (
    "cast(l_quantity as bigint) * (case when (l_orderkey*31 + l_partkey) % 7 = 0 then 1024 "
    "when (l_orderkey*31 + l_partkey) % 3 = 0 then 16 else 1 end)"
)
_START = "1433894400000 + (l_orderkey*86413 + l_partkey*7907 + l_linenumber*1299709) % 86400000"
_FIELDS = [
    "cast(2 as int) af",
    "case when (l_partkey+l_suppkey)%20 < 11 then 6 when (l_partkey+l_suppkey)%20 < 19 then 17 else 1 end prot",
    "cast(l_linenumber as int) inif", "cast(l_suppkey%4 as int) outif",
    "cast(0 as bigint) sa0", "cast(0 as bigint) sa1", "cast(0 as bigint) sa2",
    "cast(167772160 + l_suppkey as bigint) sa3",
    "cast(0 as bigint) da0", "cast(0 as bigint) da1", "cast(0 as bigint) da2",
    "cast(3221225984 + l_partkey as bigint) da3",
    "cast(1024 + (l_orderkey*7)%60000 as int) sp",
    "cast(case l_linenumber%4 when 0 then 443 when 1 then 80 when 2 then 53 else 8080 end as int) dp",
    "pk packets", "pk*(64+(l_partkey*7919+l_suppkey*104729+l_orderkey)%1459) octets",
    "st start_ms",
    "st + case when pk=1 then 0 else (l_orderkey*131+l_partkey*17+l_linenumber)%299000 end end_ms",
]
_TIMES = ["start_ms {div} 1000 as first", "cast(start_ms % 1000 as int) first_ms", "end_ms {div} 1000 as last",
          "cast(end_ms % 1000 as int) last_ms", "cast(0 as bigint) aggs"]


# `f`: flow rows with duration (0 for one packet) and integer rate
FLOWS_CTE = f"""
f0 as (select *, {_PACKETS} pk, {_START} st from (select *, row_number() over () - 1 as pos from lineitem)),
f1 as (select {", ".join(_FIELDS)}, pos from f0),
f2 as (select *, start_ms // 1000 as "first", cast(start_ms % 1000 as int) first_ms, end_ms // 1000 as "last",
       cast(end_ms % 1000 as int) last_ms, cast(0 as bigint) aggs,
       case when packets = 1 then 0 else end_ms - start_ms end as duration from f1),
f as (select *, case when duration = 0 then 0 else 8000*octets // duration end as rate from f2)"""


def with_flows(sql: str) -> str:
    """Prefix a statement (or further CTEs starting with a comma) with the flow CTE."""
    return f"with {FLOWS_CTE.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}"


def flows_of(items: DataFrame) -> DataFrame:
    """Flow columns from line items with `pos`."""
    staged = items.select("*", F.expr(_PACKETS).alias("pk"), F.expr(_START).alias("st"))
    rows = staged.selectExpr(*_FIELDS, "pos")
    return as_flows(rows.selectExpr("*", *[t.format(div="div") for t in _TIMES]).drop("start_ms", "end_ms"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per line item, `pos` being the row number in the file."""
    return flows_of(read_parquet(spark, f"{sf_dir}/lineitem.parquet"))


_EV = """select user_id, event_id pos, start_ms, start_ms + (event_id*7919*61)%14400000 end_ms,
  1 + event_id%97 packets, (1+event_id%97)*(64+(event_id*31)%1459) octets, cast(0 as bigint) aggs
  from (select event_id, user_id, {ms} start_ms from {source}) x"""

RECORDS_CTE = "ev as (" + _EV.format(ms="epoch_us(ts) // 1000", source="events") + ")"
RECORD_KEYS = ["user_id"]
INACTIVE_S, ACTIVE_S = 3600, 14400


def records_of(events: DataFrame) -> DataFrame:
    ms = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"
    return events.sparkSession.sql(_EV.format(ms=ms, source="{events}"), events=events)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one key column that overlap, touch and follow each other, for merging."""
    return records_of(spark.read.parquet(f"{sf_dir}/events.parquet"))
