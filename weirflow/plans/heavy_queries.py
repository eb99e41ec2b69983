"""Queries on heavy-hitter analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions.special import t_quantile
from weirflow.operators import coverage as C
from weirflow.operators import evaluation as E
from weirflow.operators import features as X
from weirflow.operators import histogram as H
from weirflow.operators import labels as L
from weirflow.operators import occupancy as O
from weirflow.operators import reduction as R
from weirflow.plans.distribution_queries import LENGTH, SIZE, at_points_sql
from weirflow.plans.fixtures import flows, with_flows
from weirflow.plans.registry import query

# a stand-in for a size regressor: the true size with a spread of one half
PREDICTED = "octets * (50 + (pos * 7919) % 100) / cast(100 as double)"


def predicted_flows(spark, sf):
    return flows(spark, sf).withColumn("predicted", F.expr(PREDICTED))


def rounded(df, digits, keys, skip=()):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys and c not in skip])


# --- labels, samples, folds

_RUN = ', r as (select pos, octets, sum(octets) over (order by octets desc, pos rows unbounded preceding) as run from f)'


@query("label_coverage", with_flows(_RUN + " select pos, octets, cast(run as double) < (select cast(sum(octets) as double) from f) * 0.8::double as decision from r"))
def label_coverage(spark, sf):
    return L.label_coverage(flows(spark, sf), 0.8).select("pos", "octets", "decision")


@query("top_sample", with_flows(""", n as (select cast(floor(count(*) * 0.1::double / 2) as bigint) half from f),
  r as (select pos, octets, row_number() over (order by octets desc, pos) as k from f),
  s as (select pos, octets, row_number() over (order by cast('0x' || substr(md5('7:' || pos), 1, 13) as bigint), pos) as j
        from r, n where k > half)
  select pos, octets from r, n where k <= half union all select pos, octets from s, n where j <= half"""))
def top_sample(spark, sf):
    return L.top_sample(flows(spark, sf), 0.1, seed=7).select("pos", "octets")


@query("kfold", with_flows(""", n as (select count(*) // 7 as s, count(*) % 7 as b from f)
  select pos, octets, cast(case when pos < b * (s + 1) then pos // (s + 1) else b + (pos - b * (s + 1)) // s end as int) as fold
  from f, n"""))
def kfold(spark, sf):
    return L.with_folds(flows(spark, sf), 7).select("pos", "octets", "fold")


# --- features and entropy


@query("features_raw", with_flows(" select pos, cast(sp as bigint) f0, sa3 f1, da3 f2, cast(dp as bigint) f3, cast(prot as bigint) f4 from f"))
def features_raw(spark, sf):
    return flows(spark, sf).select("pos", *[X.feature_array("raw")[i].alias(f"f{i}") for i in range(len(X.INPUTS))])


_BYTES = [f"cast(({name} >> {8 * i}) & 255 as int)" for name, width in X.INPUTS for i in range(width)]


@query("features_bytes", with_flows(" select pos, " + ", ".join(f"{b} as b{i}" for i, b in enumerate(_BYTES)) + " from f"))
def features_bytes(spark, sf):
    return flows(spark, sf).select("pos", *[c.alias(f"b{i}") for i, c in enumerate(X.byte_columns())])


@query("features_bits", with_flows(
    " select pos, " + " || ".join(f"lpad(bin({b}), 8, '0')" for b in _BYTES) + " as bits from f"))
def features_bits(spark, sf):
    return flows(spark, sf).select("pos", F.array_join(X.feature_array("bits").cast("array<string>"), "").alias("bits"))


_PLACES = f", u as (select unnest(generate_series(0, 12)) as place, unnest([{', '.join(_BYTES)}]) as v from f)"
_ENTROPY = """select cast(place as int) as place, round(-sum(p * log2(p)), 9) + 0.0 as entropy from (
  select place, cast(c as double) / sum(c) over (partition by place) as p from ({counts})) group by place"""


@query("entropy_bytes", with_flows(_PLACES + _ENTROPY.format(counts="select place, v, count(*) c from u group by 1, 2")))
def entropy_bytes(spark, sf):
    return X.entropy_bytes(flows(spark, sf)).select("place", (F.round("entropy", 9) + 0.0).alias("entropy"))


@query("entropy_bits", with_flows(_PLACES + """, b as (select place * 8 + i as place, (v >> (7 - i)) & 1 as v
  from u, range(8) r(i)) """ + _ENTROPY.format(counts="select place, v, count(*) c from b group by 1, 2")))
def entropy_bits(spark, sf):
    return X.entropy_bits(flows(spark, sf)).select("place", (F.round("entropy", 9) + 0.0).alias("entropy"))


# --- reduction

CURVE_CTE = f""", g as (select *, {PREDICTED} as predicted from f),
  th as (select cast(cast(64 as bigint) << i as double) as threshold from range(25) r(i)),
  cu as (select threshold, cast(sum(case when predicted > threshold then octets else 0 end) as double) / cast(sum(octets) as double) as coverage,
          cast(count(*) as double) / count(*) filter (where predicted > threshold) as reduction
        from g, th group by threshold having count(*) filter (where predicted > threshold) > 0)"""

# knots `kn` (x, reduction) and points `gr` (x) give `ip`
_INTERP = """, nb as (select x, (select max(k.x) from kn k where k.x <= gr.x) as lo, (select min(k.x) from kn k where k.x > gr.x) as hi from gr),
  ip as (select nb.x, case when lo = nb.x or hi is null then a.reduction
      else a.reduction + (nb.x - lo) * (b.reduction - a.reduction) / (hi - lo) end as reduction
    from nb left join kn a on a.x = lo left join kn b on b.x = hi)"""


@query("reduction_curve", with_flows(CURVE_CTE + " select threshold, coverage, reduction from cu"))
def reduction_curve(spark, sf):
    return R.reduction_curve(predicted_flows(spark, sf))


@query("reduction_interp", with_flows(CURVE_CTE + """, kn as (select x, min(reduction) reduction from (
    select coverage * 100 as x, reduction from cu union all select 100, 1) group by x),
  gr as (select (500 + i) / cast(10 as double) as x from range(510) r(i))""" + _INTERP
    + " select x, round(reduction, 6) as reduction from ip"))
def reduction_interp(spark, sf):
    return rounded(R.interpolate_reduction(R.reduction_curve(predicted_flows(spark, sf)), R.coverage_grid()), 6, ["x"])


@query("reduction_score", with_flows(CURVE_CTE + """, kn as (select coverage as x, min(reduction) reduction from cu group by 1),
  gr as (select cast(0.8 as double) as x)""" + _INTERP + " select x as coverage, round(reduction, 6) as score from ip"))
def reduction_score(spark, sf):
    return rounded(R.reduction_score(predicted_flows(spark, sf)), 6, ["coverage"])


# --- coverage curves from histograms


def _finish_sql(source: str, key: str) -> str:
    return f"""select {key}, round(flows * 100, 6) flows_mean, round(packets * 100, 6) packets_mean,
  round(fraction * 100, 6) fraction_mean, round(octets * 100, 6) octets_mean,
  round(1 / nullif(flows, 0), 4) operations_mean, round(1 / nullif(fraction, 0), 4) occupancy_mean from {source}"""


def _finish(df, keys):
    return df.select(*keys, *[F.round(f"{w}_mean", 6).alias(f"{w}_mean") for w in C.WHAT],
                     *[F.round(c, 4).alias(c) for c in ("operations_mean", "occupancy_mean")])


_POW = "select cast(1 as bigint) << i as x from range(25) r(i)"
_POW64 = "select cast(64 as bigint) << i as x from range(25) r(i)"
_FIRST = ", q as (select x, 1 - flows_cdf as flows, 1 - packets_cdf as packets, 1 - flows_cdf as fraction, 1 - octets_cdf as octets from atp) "

# values of the threshold policy at every bin, from suffix sums over bins and prefix sums of those
_THRESHOLD_H = """, s as (select *, bin_lo - coalesce(lag(bin_lo) over o, 0) as gap,
    sum(flows_sum / bin_lo) over d as fs, sum(packets_sum / bin_lo) over d as ps, sum(octets_sum / bin_lo) over d as os
    from h window o as (order by bin_lo), d as (order by bin_lo desc)),
  c as (select bin_lo, cast(sum(flows_sum) over o as double) / (select cast(sum(flows_sum) as double) from h) as flows_cdf,
    sum(fs * gap) over o / (select cast(sum(flows_sum) as double) from h) as fraction_cdf,
    sum(ps * gap) over o / (select cast(sum(packets_sum) as double) from h) as packets_cdf,
    sum(os * gap) over o / (select cast(sum(octets_sum) as double) from h) as octets_cdf
    from s window o as (order by bin_lo)), """


def _threshold_sql(points: str) -> str:
    def lin(m):
        return f"case when a.bin_lo = x then 1 - a.{m}_cdf when b.bin_lo is not null then 1 - (a.{m}_cdf + (x - a.bin_lo) * (b.{m}_cdf - a.{m}_cdf) / (b.bin_lo - a.bin_lo)) end"

    return _THRESHOLD_H + f"""pts as ({points}),
  nb as (select x, (select max(bin_lo) from c where bin_lo <= x) as lo, (select min(bin_lo) from c where bin_lo > x) as hi from pts),
  q as (select x, case when a.bin_lo = x or b.bin_lo is not null then 1 - a.flows_cdf end as flows, {lin('packets')} as packets,
    {lin('fraction')} as fraction, {lin('octets')} as octets
    from nb left join c a on a.bin_lo = lo left join c b on b.bin_lo = hi) """


_SAMPLING = """, s as (select *, bin_lo - coalesce(lag(bin_lo) over o, 0) as gap,
    cast(sum(octets_sum) over o as double) / cast(sum(packets_sum) over o as double) as pkt,
    sum(flows_sum / bin_lo) over d as fs, sum(packets_sum / bin_lo) over d as ps, sum(octets_sum / bin_lo) over d as os
    from h window o as (order by bin_lo), d as (order by bin_lo desc)),
  pr as (select 1 / cast(cast(1 as bigint) << i as double) as p from range(25) r(i)),
  m as (select *, {missed} as missed from s, pr),
  q as (select p, 1 - sum(missed * flows_sum) / cast(sum(flows_sum) as double) as flows,
    1 - sum(missed * ps * gap) / cast(sum(packets_sum) as double) as packets,
    1 - sum(missed * fs * gap) / cast(sum(flows_sum) as double) as fraction,
    1 - sum(missed * os * gap) / cast(sum(octets_sum) as double) as octets from m group by p) """
_MISSED = "pow(1 - p, cast(bin_lo as double))"
_MISSED_SIZE = "pow(1 - least(p * pkt / 64, 1), least(greatest(bin_lo / pkt, 1), floor(bin_lo / 64)))"


@query("coverage_first", with_flows(LENGTH + at_points_sql(_POW, "previous") + _FIRST + _finish_sql("q", "x")))
def coverage_first(spark, sf):
    return _finish(C.coverage_first(H.hist(flows(spark, sf), "length", 12)), ["x"])


@query("coverage_first_size", with_flows(SIZE + at_points_sql(_POW64, "previous") + _FIRST + _finish_sql("q", "x")))
def coverage_first_size(spark, sf):
    return _finish(C.coverage_first(H.hist(flows(spark, sf), "size", 12), "size"), ["x"])


@query("coverage_threshold", with_flows(LENGTH + _threshold_sql(_POW) + _finish_sql("q", "x")))
def coverage_threshold(spark, sf):
    return _finish(C.coverage_threshold(H.hist(flows(spark, sf), "length", 12)), ["x"])


@query("coverage_threshold_size", with_flows(SIZE + _threshold_sql(_POW64) + _finish_sql("q", "x")))
def coverage_threshold_size(spark, sf):
    return _finish(C.coverage_threshold(H.hist(flows(spark, sf), "size", 12), "size"), ["x"])


@query("coverage_sampling", with_flows(LENGTH + _SAMPLING.format(missed=_MISSED) + _finish_sql("q", "p")))
def coverage_sampling(spark, sf):
    return _finish(C.coverage_sampling(H.hist(flows(spark, sf), "length", 12)), ["p"])


@query("coverage_sampling_size", with_flows(SIZE + _SAMPLING.format(missed=_MISSED_SIZE) + _finish_sql("q", "p")))
def coverage_sampling_size(spark, sf):
    return _finish(C.coverage_sampling(H.hist(flows(spark, sf), "size", 12), "size"), ["p"])


# --- the policies on flow rows


def _records_sql(x: str) -> str:
    unit, value = (1, "packets") if x == "length" else (64, "octets")
    p = "level" if x == "length" else "least(level * octets / packets / 64, 1)"
    after = "level" if x == "length" else "level * packets / octets"
    return f""", lv as (select cast(cast({unit} as bigint) << i as double) as level from range(25) r(i)),
  pr as (select 1 / cast(cast(1 as bigint) << i as double) as level from range(25) r(i)),
  e as (select 'first' as method, level, packets, octets, case when {value} > level then 1.0::double else 0 end as added,
          case when {value} > level then packets::double else 0 end as pc from f, lv
        union all select 'threshold', level, packets, octets, case when {value} > level then 1 else 0 end,
          case when {value} > level then packets - {after} else 0 end from f, lv
        union all select 'sampling', level, packets, octets, 1 - pow(1 - p, packets::double),
          packets - (1 - p) * (1 - pow(1 - p, packets::double)) / p from (select *, {p} as p from f, pr)),
  q as (select method, level, sum(added) / count(*) as flows, sum(pc) / cast(sum(packets) as double) as packets,
    sum(pc / packets) / count(*) as fraction, sum(octets * (pc / packets)) / cast(sum(octets) as double) as octets
    from e group by 1, 2) """


@query("coverage_records", with_flows(_records_sql("length") + _finish_sql("q", "method, level")))
def coverage_records(spark, sf):
    return _finish(C.coverage_records(flows(spark, sf)), ["method", "level"])


@query("coverage_records_size", with_flows(_records_sql("size") + _finish_sql("q", "method, level")))
def coverage_records_size(spark, sf):
    return _finish(C.coverage_records(flows(spark, sf), "size"), ["method", "level"])


SELECTED = [99.0, 95.0, 90.0, 80.0, 75.0, 50.0]
_SELECT = """, kn as (select method, octets * 100 as x, max(1 / nullif(fraction, 0)) as oc, max(1 / nullif(flows, 0)) as op from q group by 1, 2),
  gr as (select distinct method, unnest([99.0, 95.0, 90.0, 80.0, 75.0, 50.0]::double[]) as x from q),
  nb as (select method, x, (select max(k.x) from kn k where k.x <= gr.x and k.method = gr.method) as lo,
           (select min(k.x) from kn k where k.x > gr.x and k.method = gr.method) as hi from gr),
  sel as (select nb.method, nb.x as octets_mean, case when lo = nb.x then a.oc else a.oc + (nb.x - lo) * (b.oc - a.oc) / (hi - lo) end as occupancy_mean,
    case when lo = nb.x then a.op else a.op + (nb.x - lo) * (b.op - a.op) / (hi - lo) end as operations_mean
    from nb left join kn a on a.method = nb.method and a.x = lo left join kn b on b.method = nb.method and b.x = hi) """


@query("coverage_selected", with_flows(_records_sql("length") + _SELECT + """ select method, octets_mean,
  round(occupancy_mean, 4) as occupancy_mean, round(operations_mean, 4) as operations_mean from sel"""))
def coverage_selected(spark, sf):
    return rounded(C.curve_at(C.coverage_records(flows(spark, sf)), SELECTED), 4, ["method", "octets_mean"])


@query("coverage_relative", with_flows(_records_sql("length") + _SELECT + """ select s.method, s.octets_mean,
  round(s.occupancy_mean / b.occupancy_mean, 6) as occupancy_mean, round(s.operations_mean / b.operations_mean, 6) as operations_mean
  from sel s join sel b on b.octets_mean = s.octets_mean and b.method = 'threshold'"""))
def coverage_relative(spark, sf):
    return rounded(C.relative_to(C.coverage_records(flows(spark, sf)), "threshold", SELECTED), 6, ["method", "octets_mean"])


# --- occupancy


def occupancy_sql(name: str, mask: str = "true", start: str = '"first" - (select min("first") from f)',
                  elapsed: str = '"last" - "first" + 1', timeout: int = 15) -> str:
    return f""", {name}_a as (select {start} as s, {elapsed} as e, octets, {mask} as m from f),
  {name}_s as (select s, e, octets from {name}_a where m),
  {name}_d as (select s as second, 1 as df, octets * 1000000 // e as r from {name}_s
    union all select s + e, 0, -(octets * 1000000 // e) from {name}_s
    union all select s + e + {timeout}, -1, 0 from {name}_s),
  {name}_p as (select second, sum(df) df, sum(r) r from {name}_d group by 1),
  {name} as (select g.second, cast(sum(coalesce(df, 0)) over (order by g.second) as bigint) as flows,
    cast(sum(coalesce(r, 0)) over (order by g.second) as bigint) / 1000000 as octets
    from (select unnest(generate_series(0, (select max(s + e) + {timeout} - 1 from {name}_a))) as second) g left join {name}_p using (second))"""


@query("occupancy", with_flows(occupancy_sql("oc") + " select second, flows, octets from oc"))
def occupancy(spark, sf):
    return O.occupancy(flows(spark, sf))


BIG = "octets > 1000000"


@query("occupancy_masked", with_flows(occupancy_sql("oc", BIG, "pos // 100", "packets // 50 + 1", 20) + " select second, flows, octets from oc"))
def occupancy_masked(spark, sf):
    return O.occupancy(flows(spark, sf), BIG, pps=50, fps=100, timeout=20)


@query("occupancy_ratio", with_flows(occupancy_sql("a") + occupancy_sql("b", BIG) + """, j as (select second,
    case when second >= 300 and second < 720 then a.flows / nullif(b.flows, 0) end as r,
    case when second >= 300 and second < 720 then b.octets / nullif(a.octets, 0) end as c, a.flows af, b.flows bf, a.octets ao, b.octets bo
    from a join b using (second))
  select round(min(c), 9) min_coverage, round(avg(c), 9) mean_coverage, round(max(c), 9) max_coverage,
    round(min(r), 9) min_reduction, round(avg(r), 9) mean_reduction, round(max(r), 9) max_reduction,
    round(sum(bo) / sum(ao), 9) total_coverage, round(cast(sum(af) as double) / cast(sum(bf) as double), 9) total_reduction from j"""))
def occupancy_ratio(spark, sf):
    rows = flows(spark, sf)
    ratio = O.occupancy_ratio(O.occupancy(rows), O.occupancy(rows, BIG))
    return ratio.select(*[F.round(c, 9).alias(c) for c in ratio.columns])


# --- scores

_LABELLED = f", g as (select *, {PREDICTED} as predicted from f), l as (select octets > 500000 as label, predicted > 500000 as prediction from g)"
_CONFUSION = """, c as (select count(*) filter (where not label and not prediction) as tn, count(*) filter (where not label and prediction) as fp,
  count(*) filter (where label and not prediction) as fn, count(*) filter (where label and prediction) as tp from l)"""


def _labelled(spark, sf):
    return predicted_flows(spark, sf).select((F.col("octets") > 500000).alias("label"), (F.col("predicted") > 500000).alias("prediction"))


@query("confusion", with_flows(_LABELLED + _CONFUSION + " select tn, fp, fn, tp from c"))
def confusion(spark, sf):
    return E.confusion(_labelled(spark, sf))


_RATES = """, r as (select *, (tp + tn) / (tn + fp + fn + tp) as accuracy, 2 * tp / (2 * tp + fp + fn) as true_fscore, tp / (tp + fn) as tpr,
  fn / (tp + fn) as fnr, fp / (fp + tn) as fpr, tn / (fp + tn) as tnr, tp / (tp + fp) as ppv, fp / (tp + fp) as fdr,
  fn / (fn + tn) as "for", tn / (fn + tn) as npv, tp / (tp + fn + fp) as ts from c)
  select *, tpr + tnr - 1 as informedness, ppv + npv - 1 as markedness,
    round(sqrt(tpr * tnr * ppv * npv) - sqrt(fnr * fpr * "for" * fdr), 12) as mcc from r"""


@query("class_metrics", with_flows(_LABELLED + _CONFUSION + _RATES))
def class_metrics(spark, sf):
    return E.class_metrics(E.confusion(_labelled(spark, sf))).withColumn("mcc", F.round("mcc", 12))


FOLDS_CTE = f""", n as (select count(*) // 5 as s, count(*) % 5 as b from f),
  g as (select *, {PREDICTED} as predicted,
    cast(case when pos < b * (s + 1) then pos // (s + 1) else b + (pos - b * (s + 1)) // s end as int) as fold from f, n),
  th as (select cast(cast(64 as bigint) << i as double) as threshold from range(25) r(i)),
  cu as (select fold, threshold, cast(sum(case when predicted > threshold then octets else 0 end) as double) / cast(sum(octets) as double) as coverage,
          cast(count(*) as double) / count(*) filter (where predicted > threshold) as reduction
        from g, th group by fold, threshold having count(*) filter (where predicted > threshold) > 0)"""


def _fold_curves(spark, sf):
    return R.reduction_curve(L.with_folds(predicted_flows(spark, sf), 5), by=["fold"])


@query("fold_stats", with_flows(FOLDS_CTE + " select threshold, " + ", ".join(
    f"round(avg({v}), 9) as {v}_mean, min({v}) as {v}_min, max({v}) as {v}_max, round(stddev_samp({v}), 6) as {v}_std"
    for v in ("coverage", "reduction")) + " from cu group by threshold"))
def fold_stats(spark, sf):
    s = E.fold_stats(_fold_curves(spark, sf), ["threshold"], ["coverage", "reduction"])
    return s.select("threshold", *[
        c for v in ("coverage", "reduction")
        for c in (F.round(f"{v}_mean", 9).alias(f"{v}_mean"), f"{v}_min", f"{v}_max", F.round(f"{v}_std", 6).alias(f"{v}_std"))])


_T = " ".join(f"when {n} then {t_quantile(0.975, n - 1)!r}" for n in range(2, 6))


@query("coverage_conf", with_flows(FOLDS_CTE + " select threshold, " + ", ".join(
    f"round(avg({v}), 9) as {v}_mean, round((case count({v}) {_T} end) * stddev_samp({v}) / sqrt(count({v})), 6) as {v}_conf"
    for v in ("coverage", "reduction")) + " from cu group by threshold"))
def coverage_conf(spark, sf):
    s = E.confidence(_fold_curves(spark, sf), ["threshold"], ["coverage", "reduction"])
    return s.select("threshold", *[
        c for v in ("coverage", "reduction")
        for c in (F.round(f"{v}_mean", 9).alias(f"{v}_mean"), F.round(f"{v}_conf", 6).alias(f"{v}_conf"))])


