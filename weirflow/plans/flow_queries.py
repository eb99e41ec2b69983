"""Queries on flow rows: slices, filter, merge, sort, histograms, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import histogram as H
from weirflow.operators import merge as M
from weirflow.operators import series as S
from weirflow.operators import slicing as P
from weirflow.operators import sort as O
from weirflow.plans.fixtures import (
    ACTIVE_S,
    INACTIVE_S,
    RECORD_KEYS,
    RECORDS_CTE,
    flows,
    records,
    with_flows,
)
from weirflow.plans.registry import query
from weirflow.schema import FIELDS, KEY_FIELDS, as_flows

COLS = ", ".join(f'"{c}"' for c in [*FIELDS, "pos"])
HTTPS = "prot = 6 and (sp = 443 or dp = 443)"

# --- filter and slices


@query("filter_https", with_flows(f"select {COLS} from f where {HTTPS}"))
def filter_https(spark, sf):
    return flows(spark, sf).filter(HTTPS)


@query("slice_in", with_flows(f"select {COLS} from f where pos >= 4097 and pos < 4097 + 20000"))
def slice_in(spark, sf):
    return P.slice_in(flows(spark, sf), skip=4097, count=20000)


_SURVIVORS = f", s as (select *, row_number() over (order by pos) - 1 as k from f where {HTTPS})"


@query("slice_out", with_flows(f"{_SURVIVORS} select {COLS} from s where k >= 1000 and k < 4000"))
def slice_out(spark, sf):
    return P.slice_out(flows(spark, sf).filter(HTTPS), skip=1000, count=3000)


_CONVERT = """, s as (select *, row_number() over (order by pos) - 1 as k from f
  where pos >= 1000 and pos < 51000 and prot = 17)
  select pos, sa3, da3, sp, dp, packets, octets from s where k >= 500 and k < 10500"""


@query("convert", with_flows(_CONVERT))
def convert(spark, sf):
    return P.convert(flows(spark, sf), skip_in=1000, count_in=50000, where="prot = 17", skip_out=500,
                     count_out=10000, fields=["pos", "sa3", "da3", "sp", "dp", "packets", "octets"])


@query("cut", with_flows(f"select {COLS} from f where pos >= 1000 + 500 and pos < 1000 + 30000"))
def cut(spark, sf):
    return P.cut(flows(spark, sf), skip_in=1000, count_in=30000, skip_out=500, count_out=50000)


@query("slice_fraction", with_flows(
    f", n as (select count(*) c from f) select {COLS} from f, n where pos >= c // 4 and pos < c // 4 + c // 8"))
def slice_fraction(spark, sf):
    return P.slice_fraction(flows(spark, sf), skip=0.25, count=0.125)


# --- merge

MERGE_CTE = f"""{RECORDS_CTE},
a as (select *, lag(end_ms) over k as pl,
        coalesce(start_ms <= lag(end_ms) over k, false) as ov,
        (end_ms // 1000 - start_ms // 1000) >= {ACTIVE_S} - {INACTIVE_S} as cand
      from ev window k as (partition by user_id order by start_ms, end_ms, pos)),
b as (select *, sum(case when ov and cand then 0 else 1 end) over k as run
      from a window k as (partition by user_id order by start_ms, end_ms, pos)),
c as (select *, row_number() over r - 1 as posr, first(cand and not ov) over r as op
      from b window r as (partition by user_id, run order by start_ms, end_ms, pos)),
d as (select *, case when op then posr % 2 = 0 else posr % 2 = 1 end as st from c),
e as (select *, coalesce(lag(st) over k, false) as pst
      from d window k as (partition by user_id order by start_ms, end_ms, pos)),
g as (select *, ov and pst as bad, pst and not ov and start_ms - pl < {INACTIVE_S * 1000} as joined from e),
h as (select *, sum(case when coalesce(joined, false) then 0 else 1 end) over k as island,
        coalesce(lead(bad) over k, false) as killed
      from g window k as (partition by user_id order by start_ms, end_ms, pos)),
i as (select user_id, min(pos) filter (where not coalesce(joined, false)) as pos, min(start_ms) start_ms,
        max(end_ms) end_ms, cast(sum(packets) as bigint) packets, cast(sum(octets) as bigint) octets,
        cast(count(*) as bigint) aggs, sum(case when bad then 1 else 0 end) wrong,
        sum(case when joined then 1 else 0 end) merged, bool_or(bad or killed) dropped
      from h group by user_id, island)"""


@query("merge_flows", f"""with {MERGE_CTE}
select user_id, pos, start_ms, end_ms, packets, octets, aggs from i where not dropped""")
def merge_flows(spark, sf):
    return M.merge_records(records(spark, sf), RECORD_KEYS, INACTIVE_S, ACTIVE_S)


@query("merge_stats", f"""with {MERGE_CTE}
select cast(sum(wrong) as bigint) wrong, cast(sum(merged) as bigint) merged,
  cast(sum(case when dropped then 0 else 1 end) as bigint) written from i""")
def merge_stats(spark, sf):
    return M.merge_stats(records(spark, sf), RECORD_KEYS, INACTIVE_S, ACTIVE_S)


_KEYED = {f: "cast(user_id % 3 as int)" if f == "prot" else "cast(user_id as bigint)" if f == "sa3" else "0" for f in KEY_FIELDS}


@query("merge_flow_table", f"""with {MERGE_CTE}
select {", ".join(f'cast({v} as bigint) as {f}' for f, v in _KEYED.items())}, pos, start_ms // 1000 as "first", start_ms % 1000 as first_ms,
  end_ms // 1000 as "last", end_ms % 1000 as last_ms, packets, octets, aggs from i where not dropped""")
def merge_flow_table(spark, sf):
    """Merge of whole flow records on all fourteen key fields."""
    rows = records(spark, sf).selectExpr(
        *[f"{v} as {f}" for f, v in _KEYED.items()], "pos", "start_ms div 1000 as first", "start_ms % 1000 as first_ms",
        "end_ms div 1000 as last", "end_ms % 1000 as last_ms", "packets", "octets", "aggs")
    merged = M.merge_flows(as_flows(rows), INACTIVE_S, ACTIVE_S)
    return merged.select(*[F.col(c).cast("long").alias(c) for c in [*KEY_FIELDS, "pos", "first", "first_ms", "last", "last_ms", "packets", "octets", "aggs"]])


# --- sort


@query("sort_flows", with_flows(
    f'select row_number() over (order by prot, dp, "first", pos) - 1 as "rank", {COLS} from f'))
def sort_flows(spark, sf):
    return O.sort_ranked(flows(spark, sf), ["prot", "dp", "first"])


@query("sort_reverse", with_flows(
    f'select row_number() over (order by prot desc, octets desc, pos desc) - 1 as "rank", {COLS} from f'))
def sort_reverse(spark, sf):
    return O.sort_ranked(flows(spark, sf), ["prot", "octets"], reverse=True)


@query("sort_index", with_flows(
    'select row_number() over (order by "first", first_ms, pos) - 1 as "rank", pos, sa3, da3, octets from f'))
def sort_index(spark, sf):
    rows = flows(spark, sf)
    return O.apply_index(rows.select("pos", "sa3", "da3", "octets"), O.sort_index(rows, ["first", "first_ms"]))


# --- histograms


def hist_sql(x: str, bin_exp: int = 0, additional: tuple[str, ...] = (), where: str = "true", source: str = "f") -> str:
    """Histogram statement over a CTE with columns packets, octets, duration, rate, aggs."""
    column = {"length": "packets", "size": "octets", "duration": "duration", "rate": "rate"}[x]
    width = f"(cast(1 as bigint) << greatest(0, length(bin({column})) - {bin_exp}))" if bin_exp else "1"
    extra = {
        "duration": "cast(sum(duration) as bigint) as duration_sum",
        "rate": "cast(sum(case when duration = 0 then 0 else cast(octets as hugeint)*8000000000 // duration end)"
                " // 1000000 as bigint) as rate_sum",
        "aggs": "cast(sum(aggs) as bigint) as aggs_sum",
    }
    adds = "".join(", " + extra[a] for a in additional)
    return (
        f"select {column} // {width} * {width} as bin_lo, {column} // {width} * {width} + {width} as bin_hi, "
        f"count(*) as flows_sum, cast(sum(packets) as bigint) as packets_sum, "
        f"cast(sum(octets) as bigint) as octets_sum{adds} from {source} where {where} group by 1, 2"
    )


def _hist(name, x, bin_exp=0, additional=(), where=None):
    @query(name, with_flows(hist_sql(x, bin_exp, additional, where or "true")))
    def run(spark, sf):
        return H.hist(flows(spark, sf), x, bin_exp, additional, where)


_hist("hist_length", "length")
_hist("hist_size", "size")
_hist("hist_length_log", "length", 12)
_hist("hist_size_log", "size", 12)
_hist("hist_duration", "duration", 12)
_hist("hist_rate", "rate", 12)
_hist("hist_extra", "length", 5, ("duration", "rate", "aggs"))
_hist("hist_tcp", "size", 8, (), "prot = 6")


@query("hist_combine", with_flows(hist_sql("size", 12)))
def hist_combine(spark, sf):
    rows = flows(spark, sf)
    return H.combine(H.hist(rows, "size", 12, where=f"prot {c}") for c in ("= 6", "= 17", "not in (6, 17)"))


@query("hist_rebin", with_flows(hist_sql("size", 10)))
def hist_rebin(spark, sf):
    return H.rebin(H.hist(flows(spark, sf), "size"), 10)


# --- series


def traffic_sql(first_n: int | None = None) -> str:
    """Per-second packets and octets from the number of packets up to the end of each second of a flow."""
    m = "packets" if first_n is None else f"least(packets, {first_n})"
    return f""", p as (select "first", first_ms as fm, packets, octets, {m} as m, duration as d,
    unnest(generate_series(0, (first_ms + duration) // 1000)) as s from f),
  k as (select *, case when d = 0 then m else least(m, ((s + 1)*1000*packets - fm*packets + d - 1) // d) end as k1,
          case when s = 0 then 0 when d = 0 then m else least(m, (s*1000*packets - fm*packets + d - 1) // d) end as k0 from p),
  t as (select "first" + s as sec, cast(sum(case when s = 0 then 1 else 0 end) as bigint) flows,
          cast(sum(k1 - k0) as bigint) packets,
          cast(sum(cast(k1 as hugeint)*octets // packets - cast(k0 as hugeint)*octets // packets) as bigint) octets
        from k where k1 > k0 group by 1),
  ser as (select sec // 86400 as day, cast(sec % 86400 as int) as second, flows, packets, octets from t)"""


DENSE_CTE = """, days as (select distinct unnest(generate_series("first" // 86400,
    (case when packets = 1 then "first" else "last" end) // 86400)) as day from f),
  grid as (select day, cast(s as int) as second from days, range(86400) r(s)),
  den as (select g.day, g.second, coalesce(flows, 0) flows, coalesce(packets, 0) packets, coalesce(octets, 0) octets
          from grid g left join ser using (day, second))"""


@query("series_flows", with_flows(
    'select "first" // 86400 as day, cast("first" % 86400 as int) as second, count(*) as flows from f group by 1, 2'))
def series_flows(spark, sf):
    return S.arrival_series(flows(spark, sf))


@query("series_packets", with_flows(traffic_sql() + " select day, second, packets from ser"))
def series_packets(spark, sf):
    return S.traffic_series(flows(spark, sf)).select("day", "second", "packets")


@query("series_octets", with_flows(traffic_sql() + " select day, second, octets from ser"))
def series_octets(spark, sf):
    return S.traffic_series(flows(spark, sf)).select("day", "second", "octets")


@query("series_dense", with_flows(traffic_sql() + DENSE_CTE + " select day, second, flows, packets, octets from den"))
def series_dense(spark, sf):
    rows = flows(spark, sf)
    return S.dense(S.traffic_series(rows), S.touched_days(rows))


_ROLLING = """ select day, second, round(avg(flows) over w, 6) as flows_mean, round(avg(packets) over w, 6) as packets_mean,
  round(avg(octets * 8) over w, 6) as bits_mean from den
  window w as (partition by day order by second rows between 29 preceding and current row)"""


@query("series_rolling", with_flows(traffic_sql() + DENSE_CTE + _ROLLING))
def series_rolling(spark, sf):
    rows = flows(spark, sf)
    rolled = S.rolling_mean(S.dense(S.traffic_series(rows), S.touched_days(rows)))
    return rolled.select("day", "second", *[F.round(c, 6).alias(c) for c in ("flows_mean", "packets_mean", "bits_mean")])


@query("series_first_n", with_flows(traffic_sql(10) + " select day, second, flows, packets, octets from ser"))
def series_first_n(spark, sf):
    return S.traffic_series(flows(spark, sf), first_n=10)


@query("series_daily", with_flows(traffic_sql() + """ select day, strftime(date '1970-01-01' + cast(day as int), '%Y-%m-%d') as "date",
  cast(sum(flows) as bigint) flows, cast(sum(packets) as bigint) packets, cast(sum(octets) as bigint) octets,
  cast(sum(octets) as bigint) * 8 as bits from ser group by day"""))
def series_daily(spark, sf):
    return S.daily_totals(S.traffic_series(flows(spark, sf)))


