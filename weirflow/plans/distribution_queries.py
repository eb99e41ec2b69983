"""Queries on distribution functions of histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import distribution as D
from weirflow.operators import histogram as H
from weirflow.plans.fixtures import flows, with_flows
from weirflow.plans.flow_queries import hist_sql
from weirflow.plans.registry import query

LENGTH = ", h as (" + hist_sql("length", 12) + ")"
SIZE = ", h as (" + hist_sql("size", 12) + ")"
SIZE_UNIT = ", h as (" + hist_sql("size") + ")"
FULL = ", h as (" + hist_sql("length", 12, ("duration", "rate")) + ")"

CDF_CTE = """, c as (select bin_lo, flows_sum, packets_sum, octets_sum,
    cast(sum(flows_sum) over o as double) / cast(sum(flows_sum) over () as double) as flows_cdf,
    cast(sum(packets_sum) over o as double) / cast(sum(packets_sum) over () as double) as packets_cdf,
    cast(sum(octets_sum) over o as double) / cast(sum(octets_sum) over () as double) as octets_cdf
  from h window o as (order by bin_lo))"""


def at_points_sql(points_cte: str, how: str = "linear") -> str:
    """CTE `atp`: CDF of `c` at the points of `points_cte` (column x)."""
    cols = []
    for m in ("flows", "packets", "octets"):
        if how == "linear":
            v = (f"case when a.bin_lo = x then a.{m}_cdf else a.{m}_cdf + (x - a.bin_lo) * (b.{m}_cdf - a.{m}_cdf)"
                 f" / (b.bin_lo - a.bin_lo) end")
        else:
            v = f"a.{m}_cdf"
        cols.append(f"case when a.bin_lo = x or b.bin_lo is not null then {v} end as {m}_cdf")
    return f"""{CDF_CTE}, pts as ({points_cte}),
  nb as (select x, (select max(bin_lo) from c where bin_lo <= x) as lo, (select min(bin_lo) from c where bin_lo > x) as hi from pts),
  atp as (select x, {", ".join(cols)} from nb left join c a on a.bin_lo = nb.lo left join c b on b.bin_lo = nb.hi)"""


def _length(spark, sf):
    return H.hist(flows(spark, sf), "length", 12)


def _size(spark, sf):
    return H.hist(flows(spark, sf), "size", 12)


@query("cdf", with_flows(LENGTH + CDF_CTE + " select bin_lo, flows_cdf, packets_cdf, octets_cdf from c"))
def cdf(spark, sf):
    return D.cdf(_length(spark, sf))


@query("cdf_unit", with_flows(SIZE_UNIT + CDF_CTE + " select bin_lo, flows_cdf, packets_cdf, octets_cdf from c"))
def cdf_unit(spark, sf):
    return D.cdf(H.hist(flows(spark, sf), "size"), bucket=D.unit_bucket())


POINTS = [64 * 3**i for i in range(14)]
_POINTS_SQL = "select cast(64 * 3**i as bigint) as x from range(14) r(i)"
_CDF9 = " select x, " + ", ".join(f"round({m}_cdf, 9) as {m}_cdf" for m in D.METRICS) + " from atp"


def _round(df, digits, keys=("x",), suffix="_cdf"):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c.endswith(suffix)])


@query("cdf_at_points", with_flows(SIZE + at_points_sql(_POINTS_SQL) + _CDF9))
def cdf_at_points(spark, sf):
    return _round(D.cdf_at(_size(spark, sf), POINTS), 9)


@query("cdf_previous", with_flows(SIZE_UNIT + at_points_sql(_POINTS_SQL, "previous") + _CDF9))
def cdf_previous(spark, sf):
    return _round(D.cdf_at(H.hist(flows(spark, sf), "size"), POINTS, "previous"), 9)


_LINE = """select distinct cast(case when i = 0 then lo when i = 127 then hi else round_even(lo * pow(hi / lo, i / 127.0), 0) end as bigint) as x
  from range(128) r(i), (select cast(min(bin_lo) as double) lo, cast(max(bin_lo) as double) hi from h)"""
_PDF = """, pd as (select x, """ + ", ".join(
    f"coalesce(({m}_cdf - lag({m}_cdf) over o) / (x - lag(x) over o), {m}_cdf) as {m}_pdf" for m in D.METRICS
) + " from atp window o as (order by x))"


@query("pdf_from_cdf", with_flows(SIZE + at_points_sql(_LINE) + _PDF + " select x, " + ", ".join(
    f"round({m}_pdf * 1e6, 6) as {m}_ppm" for m in D.METRICS) + " from pd"))
def pdf_from_cdf(spark, sf):
    h = _size(spark, sf)
    pdf = D.pdf_from_cdf(h, D.line_points(h))
    return pdf.select("x", *[F.round(F.col(f"{m}_pdf") * 1e6, 6).alias(f"{m}_ppm") for m in D.METRICS])


@query("avg_line", with_flows(LENGTH + at_points_sql(_LINE) + _PDF + """ select x,
  round((select cast(sum(octets_sum) as double) / cast(sum(flows_sum) as double) from h) * octets_pdf / nullif(flows_pdf, 0), 4)
  as octets_avg from pd"""))
def avg_line(spark, sf):
    h = _length(spark, sf)
    return D.avg_line(h, D.line_points(h)).select("x", F.round("octets_avg", 4).alias("octets_avg"))


_NORMAL = """, n as (select *, coalesce(lead(bin_lo) over o,
      (2*bin_lo - lag(bin_lo) over o) // (cast(1 as bigint) << greatest(0, length(bin(2*bin_lo - lag(bin_lo) over o)) - 12))
      * (cast(1 as bigint) << greatest(0, length(bin(2*bin_lo - lag(bin_lo) over o)) - 12))) - bin_lo as gap
    from h window o as (order by bin_lo)) select bin_lo, flows_sum, """ + ", ".join(
    f"cast({m}_sum as double) / gap / cast(sum({m}_sum) over () as double) as {m}_pdf" for m in D.METRICS) + " from n"


@query("pdf_normalized", with_flows(SIZE + _NORMAL))
def pdf_normalized(spark, sf):
    return D.pdf_points(_size(spark, sf), normalize=True, bin_exp=12)


@query("pdf_points", with_flows(SIZE + " select bin_lo, flows_sum, " + ", ".join(
    f"cast({m}_sum as double) / cast(sum({m}_sum) over () as double) as {m}_pdf" for m in D.METRICS) + " from h"))
def pdf_points(spark, sf):
    return D.pdf_points(_size(spark, sf), normalize=False)


@query("avg_per_bin", with_flows(FULL + """ select bin_lo, packets_sum / flows_sum as packets_avg,
  octets_sum / flows_sum as octets_avg, octets_sum / packets_sum as packet_size,
  duration_sum / packets_sum as packet_iat from h"""))
def avg_per_bin(spark, sf):
    return D.avg_per_bin(H.hist(flows(spark, sf), "length", 12, ("duration", "rate")))


@query("packet_size", with_flows(FULL + """ select 'packet_size' as what, min(octets_sum / packets_sum) as low,
  cast(sum(octets_sum) as double) / cast(sum(packets_sum) as double) as mean, max(octets_sum / packets_sum) as high from h
  union all select 'packet_iat', min(duration_sum / packets_sum),
  cast(sum(duration_sum) as double) / cast(sum(packets_sum) as double), max(duration_sum / packets_sum) from h"""))
def packet_size(spark, sf):
    return D.packet_ranges(H.hist(flows(spark, sf), "length", 12, ("duration", "rate")))


@query("summary_stats", with_flows(FULL + """ select cast(sum(flows_sum) as bigint) as flows,
  cast(sum(packets_sum) as bigint) as packets, cast(sum(octets_sum) as bigint) as octets,
  """ + ", ".join(f"cast(sum({c}) as double) / cast(sum(flows_sum) as double) as {n}" for c, n in (
    ("packets_sum", "avg_length"), ("octets_sum", "avg_size"), ("duration_sum", "avg_duration"), ("rate_sum", "avg_rate")
)) + ", cast(sum(octets_sum) as double) / cast(sum(packets_sum) as double) as avg_packet_size from h"))
def summary_stats(spark, sf):
    return D.summary_stats(H.hist(flows(spark, sf), "length", 12, ("duration", "rate")))


@query("summary_cdf", with_flows(
    LENGTH + at_points_sql("select cast(1 as bigint) << i as x from range(25) r(i)") + " select x, " + ", ".join(
        f"round({m}_cdf * 100, 6) as {m}_pct" for m in D.METRICS) + " from atp"))
def summary_cdf(spark, sf):
    return _round(D.summary_cdf(_length(spark, sf), "length"), 6, suffix="_pct")


@query("summary_cdf_size", with_flows(
    SIZE + at_points_sql("select cast(64 as bigint) << i as x from range(25) r(i)") + " select x, " + ", ".join(
        f"round({m}_cdf * 100, 6) as {m}_pct" for m in D.METRICS) + " from atp"))
def summary_cdf_size(spark, sf):
    return _round(D.summary_cdf(_size(spark, sf), "size"), 6, suffix="_pct")


_SHARES = """, d as (select bin_lo, flows_sum, """ + ", ".join(
    f"cast({m}_sum as double) / cast(sum({m}_sum) over () as double) as {m}_pdf" for m in D.METRICS) + " from h)"


@query("value_ranges", with_flows(SIZE + _SHARES + """ select min(bin_lo) as xmin, max(bin_lo) as xmax,
  least(min(flows_pdf), min(packets_pdf), min(octets_pdf)) as ymin,
  greatest(max(flows_pdf), max(packets_pdf), max(octets_pdf)) as ymax from d"""))
def value_ranges(spark, sf):
    points = D.pdf_points(_size(spark, sf), normalize=False)
    return D.value_ranges([points.select("bin_lo", F.col(f"{m}_pdf").alias("y")) for m in D.METRICS], "bin_lo", ["y"])


_HIST2D = """, r as (select cast(min(bin_lo) as double) x0, cast(max(bin_lo) as double) x1, min(octets_pdf) y0, max(octets_pdf) y1 from d),
  e as (select i, x0 * pow(x1 / x0, i / 63.0) as ex, y0 * pow(y1 / y0, i / 63.0) as ey from r, range(1, 63) t(i)),
  b as (select (select count(*) from e where bin_lo >= ex) as ix, (select count(*) from e where octets_pdf >= ey) as iy, flows_sum from d)
  select cast(ix as int) as ix, cast(iy as int) as iy, cast(sum(flows_sum) as bigint) as weight from b group by 1, 2 having sum(flows_sum) >= 1"""


@query("hist2d", with_flows(SIZE + _SHARES + _HIST2D))
def hist2d(spark, sf):
    return D.hist2d(D.pdf_points(_size(spark, sf), normalize=False), "bin_lo", "octets_pdf", "flows_sum")


_KDE = ", h as (" + hist_sql("size", 6) + ")" + _SHARES + """, l as (
    select log10(bin_lo) as u, log10(octets_pdf) as v, cast(flows_sum as double) as w from d),
  m as (select sum(w) as n, sum(w*w) as n2, sum(w*u)/sum(w) as mu, sum(w*v)/sum(w) as mv,
          min(u) u0, max(u) u1, min(v) v0, max(v) v1 from l),
  k as (select n, u0, u1, v0, v1, pow(n*n/n2, -1/3.0) / (1 - n2/(n*n)) as f,
          (select sum(w*(u-mu)*(u-mu))/sum(w) from l) as a, (select sum(w*(u-mu)*(v-mv))/sum(w) from l) as b,
          (select sum(w*(v-mv)*(v-mv))/sum(w) from l) as c from m),
  q as (select *, a*f as cuu, b*f as cuv, c*f as cvv, a*f*c*f - b*f*b*f as det from k),
  g as (select cast(i as int) as ix, cast(j as int) as iy, u0 + i*(u1-u0)/63 as gu, v0 + j*(v1-v0)/63 as gv
        from q, range(64) s(i), range(64) t(j))
  select ix, iy, round(pow(10, any_value(gu)), 4) as x, round(pow(10, any_value(gv)) * 1e6, 4) as y_ppm,
    round(sum(w * exp(-0.5*((gu-u)*(gu-u)*cvv - 2*(gu-u)*(gv-v)*cuv + (gv-v)*(gv-v)*cuu)/det))
          / (any_value(n)*2*pi()*sqrt(any_value(det))), 6) as density
  from g, l, q group by ix, iy"""


@query("kde_grid", with_flows(_KDE))
def kde_grid(spark, sf):
    points = D.pdf_points(H.hist(flows(spark, sf), "size", 6), normalize=False)
    return D.kde_grid(points, "bin_lo", "octets_pdf", "flows_sum").select(
        "ix", "iy", F.round("x", 4).alias("x"), F.round(F.col("y") * 1e6, 4).alias("y_ppm"),
        F.round("density", 6).alias("density"))
