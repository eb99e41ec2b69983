"""Queries whose SQL proves model operators: mixtures in closed form, single-component fits, stumps, packed frames."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from weirflow.functions.flowcols import end_ms, start_ms
from weirflow.functions.hashing import uniform
from weirflow.operators import anonymize as A
from weirflow.operators import coverage as C
from weirflow.operators import coverage_mixture as CM
from weirflow.operators import distribution as D
from weirflow.operators import features as X
from weirflow.operators import fitting as FIT
from weirflow.operators import generate as G
from weirflow.operators import histogram as H
from weirflow.operators import learning as L
from weirflow.operators import mixture as M
from weirflow.plans.distribution_queries import LENGTH, SIZE_UNIT
from weirflow.plans.fixtures import flows, with_flows
from weirflow.plans.heavy_queries import _BYTES, _MISSED_SIZE, _SAMPLING, PREDICTED, _finish, _finish_sql, predicted_flows
from weirflow.plans.model_queries import KEY, MIXED, _complete_sql, _uniform_sql
from weirflow.plans.registry import query
from weirflow.sources.derived import flatten

# --- mixtures in closed form, scaled to the totals of the table

CLOSED = {
    "flows": [M.Component(0.3, "uniform", (0.0, 8.0)), M.Component(0.5, "genpareto", (1.45, 1.0, 23.2)), M.Component(0.2, "weibull_min", (0.75, 0.0, 900.0))],
    "packets": [M.Component(0.2, "uniform", (0.0, 30.0)), M.Component(0.5, "weibull_min", (0.6, 0.0, 5000.0)), M.Component(0.3, "genpareto", (0.8, 1.0, 200.0))],
    "octets": [M.Component(0.6, "weibull_min", (0.5, 0.0, 20000.0)), M.Component(0.4, "genpareto", (0.7, 1.0, 900.0))],
    "duration": [M.Component(1.0, "weibull_min", (0.9, 0.0, 30000.0))],
}


def closed(spark, sf) -> dict[str, tuple[int, list[M.Component]]]:
    row = flows(spark, sf).agg(F.count("*"), F.sum("packets"), F.sum("octets"), F.sum(end_ms() - start_ms())).first()
    return {m: (int(total), CLOSED[m]) for m, total in zip(CLOSED, row)}


_TOTALS = ", tl as (select count(*) as flows, sum(packets) as packets, sum(octets) as octets, sum(end_ms - start_ms) as duration from f)"


def cdf_sql(c: M.Component, v: str) -> str:
    shape, loc, scale = (0.0, *c.params) if c.dist == "uniform" else c.params
    z = f"(({v}) - {loc!r}::double) / {scale!r}::double"
    return {"uniform": f"least(greatest({z}, 0), 1)",
            "weibull_min": f"(1 - exp(-pow(greatest({z}, 0), {shape!r}::double)))",
            "genpareto": f"(1 - pow(1 + {shape!r}::double * greatest({z}, 0), {-1 / shape if shape else 0!r}::double))"}[c.dist]


def density_sql(c: M.Component, v: str) -> str:
    shape, loc, scale = (0.0, *c.params) if c.dist == "uniform" else c.params
    z, s = f"((({v}) - {loc!r}::double) / {scale!r}::double)", f"{scale!r}::double"
    return {"uniform": f"case when {z} >= 0 and {z} <= 1 then 1 / {s} else 0 end",
            "weibull_min": f"case when {z} > 0 then {shape!r}::double * pow({z}, {shape - 1!r}::double) * exp(-pow({z}, {shape!r}::double)) / {s} else 0 end",
            "genpareto": f"case when {z} >= 0 then pow(1 + {shape!r}::double * {z}, {-1 / shape - 1 if shape else 0!r}::double) / {s} else 0 end"}[c.dist]


def pdf_sql(c: M.Component, x: str, first: int = 1) -> str:
    step = f"({cdf_sql(c, x)} - {cdf_sql(c, f'case when {x} = {first} then 0 else {x} - 1 end')})"
    return f"case when {x} < 1024 then {step} else {density_sql(c, x)} end"


def mix_sql(mix, fn, *args) -> str:
    return "(" + " + ".join(f"{c.weight!r}::double * ({fn(c, *args)})" for c in mix) + ")"


def average_sql(what: str, x: str, first: int = 1) -> str:
    top, base = {"packets": ("packets", "flows"), "octets": ("octets", "flows"), "packet_size": ("octets", "packets"),
                 "packet_iat": ("duration", "packets")}[what]
    return (f"(select {top}::double / {base}::double from tl) * {mix_sql(CLOSED[top], pdf_sql, x, first)}"
            f" / nullif({mix_sql(CLOSED[base], pdf_sql, x, first)}, 0)")


def bins(spark, sf):
    return H.hist(flows(spark, sf), "length", 12).select(F.col("bin_lo").cast("double").alias("x"))


_X = LENGTH + ", p as (select cast(bin_lo as double) as x from h)"


@query("mixture_components_closed", with_flows(_X + " ".join(
    f" {'union all ' if i else ''}select x, {i} as component, '{c.dist}' as dist, round({c.weight!r}::double * {cdf_sql(c, 'x')}, 9) as cdf,"
    f" round({c.weight!r}::double * ({pdf_sql(c, 'x')}), 9) as pdf from p" for i, c in enumerate(CLOSED["flows"]))))
def mixture_components_closed(spark, sf):
    return M.components(bins(spark, sf), CLOSED["flows"]).select(
        "x", "component", "dist", F.round("cdf", 9).alias("cdf"), F.round("pdf", 9).alias("pdf"))


_AVERAGES = ("packets", "octets", "packet_size", "packet_iat")


@query("mixture_avg_closed", with_flows(_X + _TOTALS + " select x, " + ", ".join(
    f"round({average_sql(w, 'x')}, 2) as {w}" for w in _AVERAGES) + " from p"))
def mixture_avg_closed(spark, sf):
    mixtures = closed(spark, sf)
    return bins(spark, sf).select("x", *[F.round(M.mix_average(mixtures, F.col("x"), w), 2).alias(w) for w in _AVERAGES])


def _draw_sql(seed: int) -> str:
    """Whole values of the flows mixture by inverse CDF."""
    u, w = (_uniform_sql(f"{seed}{t}", "id") for t in "uw")
    return f"""select id, cast(trunc(case when w < 0.3::double then 8 * u when w < 0.8::double
      then 1 + 23.2::double * (pow(1 - u, -1.45::double) - 1) / 1.45::double else 900 * pow(-ln(1 - u), 1 / 0.75::double) end) as bigint) + 1 as x
    from (select id, {u} as u, {w} as w from (select unnest(generate_series(0, (select count(*) - 1 from f))) as id))"""


@query("generate_mixture_closed", with_flows(_TOTALS + f""", s as ({_draw_sql(31)}),
  j as (select id, x, coalesce({average_sql('packet_size', 'cast(x as double)')}, 64) as ps, {_uniform_sql('31r', 'id')} as u from s)
  select id, {_complete_sql('length')} from j"""))
def generate_mixture_closed(spark, sf):
    mixtures = closed(spark, sf)
    return G.sample_mixture(spark, mixtures, mixtures["flows"][0], seed=31)


@query("reduction_mixture_closed", with_flows(f""", u as (select distinct 64 * cast(round_even(pow(2, id * 32 / 1023::double), 0) as bigint) as threshold
    from range(1024) r(id)),
  c as (select threshold, 1 - {mix_sql(CLOSED['octets'], cdf_sql, 'threshold')} as coverage,
    1 / nullif(1 - {mix_sql(CLOSED['flows'], cdf_sql, 'threshold')}, 0) as reduction from u where (select count(*) from f) > 0)
  select threshold, round(coverage, 9) as coverage, round(reduction, 3) as reduction from c where coverage > 0.4"""))
def reduction_mixture_closed(spark, sf):
    curve = CM.reduction_mixture(spark, closed(spark, sf))
    return curve.select("threshold", F.round("coverage", 9).alias("coverage"), F.round("reduction", 3).alias("reduction"))


def _grid_sql(unit: int) -> str:
    cdfs = ", ".join(f"{mix_sql(CLOSED[m], cdf_sql, 'x')} as {m}_cdf" for m in CM.METRICS)
    sums = ", ".join(f"{m}_cdf - coalesce(lag({m}_cdf) over o, 0) as {m}_sum" for m in CM.METRICS)
    return f""", gx as (select distinct cast(round_even({unit} * pow(16777216, id / 262143::double), 0) as bigint) as x from range(262144) r(id)),
  gc as (select x, {cdfs} from gx),
  g as (select *, row_number() over o - 1 as i, x - coalesce(lag(x) over o, 0) as gap, {sums} from gc window o as (order by x))"""


def _closed_curves_sql(x_value: str) -> str:
    unit = 64 if x_value == "size" else 1
    beyond = {m: f"1 - {mix_sql(CLOSED[m], cdf_sql, 'level')}" for m in CM.METRICS}
    steps = ", ".join(f"sum({m}_sum / x) over (order by x desc rows unbounded preceding) * gap as {m}_step" for m in CM.METRICS)
    if x_value == "size":
        moved = ", ".join(f"case when i < 64 then 0 when i = 64 then {m}_step + sum(case when i < 64 then {m}_step end) over () else {m}_step end as {m}_step"
                          for m in CM.METRICS)
        size = "(octets_cdf / nullif(packets_cdf, 0)) * (select octets::double / packets::double from tl)"
        sampled = f""", s1 as (select *, {steps} from g), s2 as (select * exclude ({', '.join(m + '_step' for m in CM.METRICS)}), {moved}, {size} as sz from s1),
  st as (select *, least(greatest(x / sz, 1), floor(x / 64)) as pk, case when i < 64 then x else sz end as ps from s2)"""
        missed = "pow(1 - least(level * ps / 64, 1), pk)"
    else:
        sampled, missed = f", st as (select *, {steps} from g)", "pow(1 - level, cast(x as double))"
    return f"""{_TOTALS}{_grid_sql(unit)}, lv as (select cast({unit} * (cast(1 as bigint) << n) as double) as level from range(25) r(n)),
  pr as (select 1 / cast(cast(1 as bigint) << n as double) as level from range(25) r(n)){sampled},
  th as (select level, {", ".join(f"sum({m}_sum) filter (where x <= level) as {m}_upto, coalesce(sum({m}_sum / x) filter (where x > level), 0) as {m}_per" for m in CM.METRICS)}
    from g, lv group by level),
  q as (select 'first' as method, level, {beyond['flows']} as flows, {beyond['packets']} as packets, {beyond['flows']} as fraction, {beyond['octets']} as octets from lv
    union all select 'threshold', level, {beyond['flows']}, 1 - (packets_upto + level * packets_per), 1 - (flows_upto + level * flows_per),
      1 - (octets_upto + level * octets_per) from th
    union all select 'sampling', level, 1 - sum({missed} * flows_sum), 1 - sum({missed} * packets_step), 1 - sum({missed} * flows_step),
      1 - sum({missed} * octets_step) from st, pr group by level)
  select method, level, round(flows * 100, 6) flows_mean, round(packets * 100, 6) packets_mean, round(fraction * 100, 6) fraction_mean,
    round(octets * 100, 6) octets_mean, round(ln(1 / nullif(flows, 0)), 5) ln_operations, round(ln(1 / nullif(fraction, 0)), 5) ln_occupancy from q"""


def _closed_curves(spark, sf, x_value):
    mixtures = closed(spark, sf)
    out = []
    for method in ("first", "threshold", "sampling"):
        c = CM.coverage_mixture(spark, mixtures, method, x_value)
        out.append(c.select(
            F.lit(method).alias("method"), F.col(c.columns[0]).cast("double").alias("level"),
            *[F.round(f"{w}_mean", 6).alias(f"{w}_mean") for w in C.WHAT],
            F.round(F.log("operations_mean"), 5).alias("ln_operations"), F.round(F.log("occupancy_mean"), 5).alias("ln_occupancy")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("coverage_mixture_closed", with_flows(_closed_curves_sql("length")))
def coverage_mixture_closed(spark, sf):
    return _closed_curves(spark, sf, "length")


@query("coverage_mixture_closed_size", with_flows(_closed_curves_sql("size")))
def coverage_mixture_closed_size(spark, sf):
    return _closed_curves(spark, sf, "size")


# --- samples of parts without a closed inverse: the CDF of each gamma value must be the uniform that made it


def _erlang(z, shape: int):
    """CDF of a gamma distribution of whole shape at z, a finite sum."""
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, shape):
        term = term * z / i
        total = total + term
    return 1 - F.exp(-z) * total


_SAMPLED = """, d as (select id, {u} as u, {v} as v, {w} as w from (select unnest(generate_series(0, (select count(*) - 1 from f))) as id)),
  n as (select *, sqrt(-2 * ln(1 - u)) * cos(v * 6.283185307179586::double) as z from d)
  select id, case when w < 0.4::double then 0 when w < 0.7::double then 1 when w < 0.9::double then 2 else 3 end as part,
    round(case when w < 0.4::double then 6 * u when w < 0.7::double then 2 * z + ln(20) when w < 0.9::double then u else 900 + 150 * z end, 6) as value
  from n""".format(**{t: _uniform_sql(f"41{t}", "id") for t in "uvw"})


@query("mixture_sample_parts", with_flows(_SAMPLED))
def mixture_sample_parts(spark, sf):
    """Sampled doubles of a uniform, a lognormal, a gamma and a normal part, each in the scale of its uniform or normal."""
    rows = M.sample(spark, MIXED, flows(spark, sf).count(), x_value="double", seed=41)
    w = uniform("41w", F.col("id"))
    part = F.when(w < 0.4, 0).when(w < 0.4 + 0.3, 1).when(w < 0.4 + 0.3 + 0.2, 2).otherwise(3)
    x = F.col("x")
    value = F.when(part == 0, x).when(part == 1, F.log(x)).when(part == 2, _erlang(x / 200, 5)).otherwise(x)
    return rows.select("id", part.alias("part"), F.round(value, 6).alias("value"))


# --- one step of the fit with one component: plain weighted moments, and the roots of the two shape equations

_MOMENTS = """, b as (select cast(bin_lo as double) as x, cast(flows_sum as double) as fw, cast(packets_sum as double) as pw, cast(octets_sum as double) as ow from h),
  nm as (select sum(fw * x) / sum(fw) as m, sum(fw * x * x) / sum(fw) as q from b),
  ln_ as (select sum(pw * ln(x)) / sum(pw) as m, sum(pw * ln(x) * ln(x)) / sum(pw) as q from b),
  gm as (select sum(ow * x) / sum(ow) / 2 as scale, sum(ow * ln(x)) / sum(ow) - ln(sum(ow * x) / sum(ow) / 2) as target from b),
  ga as (with recursive s(i, lo, hi) as (select 0, 0.001::double, 1000::double union all
      select i + 1, case when (lgamma((lo + hi) / 2 + 1e-4) - lgamma((lo + hi) / 2 - 1e-4)) / 2e-4 < (select target from gm) then (lo + hi) / 2 else lo end,
        case when (lgamma((lo + hi) / 2 + 1e-4) - lgamma((lo + hi) / 2 - 1e-4)) / 2e-4 < (select target from gm) then hi else (lo + hi) / 2 end from s where i < 60)
    select (lo + hi) / 2 as a from s where i = 60)"""


def _weibull_sql() -> str:
    out = """, ws as (select 400::double * pow(sum(fw * pow(x / 400, 0.8::double)) / sum(fw), 1 / 0.8::double) as l from b), k0 as (select 1::double as k)"""
    for i in range(FIT.NEWTON_STEPS):
        z = "(ln(x) - ln(l))"
        t = f"fw * exp(k * {z})"
        out += f""", k{i + 1} as (select greatest(k - (sum(fw) / k + sum(fw * {z}) - sum({t} * {z})) / (-sum(fw) / (k * k) - sum({t} * {z} * {z})), k / 10) as k
    from b, ws, k{i} group by k, l)"""
    return out


@query("mixture_fit_moments", with_flows(LENGTH + _MOMENTS + _weibull_sql() + f""" select 'norm' as dist, round(m, 6) as p0, round(sqrt(q - m * m), 4) as p1 from nm
  union all select 'lognorm', round(sqrt(q - m * m), 6), round(exp(m), 4) from ln_
  union all select 'gamma', round(a, 4), round(scale, 4) from ga, gm
  union all select 'weibull_min', round(k, 6), round(l, 4) from k{FIT.NEWTON_STEPS}, ws"""))
def mixture_fit_moments(spark, sf):
    h = H.hist(flows(spark, sf), "length", 12)
    starts = {"flows": [M.Component(1.0, "norm", (500.0, 20000.0))], "packets": [M.Component(1.0, "lognorm", (3.0, 0.0, 300.0))],
              "octets": [M.Component(1.0, "gamma", (2.0, 0.0, 9000.0))]}
    fits = FIT.fit_many(h, starts, 1)
    weibull = FIT.fit_many(h, {"flows": [M.Component(1.0, "weibull_min", (0.8, 0.0, 400.0))]}, 1)
    rows = []
    for _, (c,) in [*fits.values(), *weibull.values()]:
        first, digits = c.params[0], {"gamma": 4}.get(c.dist, 6)
        rows.append((c.dist, round(float(first), digits), round(float(c.params[-1]), 4)))
    return spark.createDataFrame(rows, "dist string, p0 double, p1 double")


# --- learners: what can be said of them without a model


@query("sample_weights", with_flows(" select pos, round(sqrt(octets), 6) as classify, cast(octets as double) * octets as regress from f"))
def sample_weights(spark, sf):
    return flows(spark, sf).select("pos", F.round(L.sample_weight(L.CLASSIFY_POWER), 6).alias("classify"), L.sample_weight(L.REGRESS_POWER).alias("regress"))


_STUMP = f""", fx as (select octets::double as y, unnest([{', '.join(_BYTES)}]) as v, unnest(generate_series(0, 12)) as i from f),
  pv as (select i, v, count(*)::double as n, sum(y) as s, sum(y * y) as q from fx group by 1, 2),
  cm as (select i, v, sum(n) over w as n, sum(s) over w as s, sum(q) over w as q, sum(n) over (partition by i) as tn,
    sum(s) over (partition by i) as ts, sum(q) over (partition by i) as tq from pv window w as (partition by i order by v)),
  gn as (select i, max((tq - ts * ts / tn) - (q - s * s / n) - ((tq - q) - (ts - s) * (ts - s) / (tn - n))) as gain from cm where n < tn group by i)
  select cast(arg_max(i, gain) as int) as feature, 1.0::double as importance, 1.0::double as depth, 2.0::double as leaves from gn"""


@query("tree_shape", with_flows(_STUMP))
def tree_shape(spark, sf):
    """The one split of a tree of depth 1 on 13 bytes, from its importances, depth and leaves."""
    data = X.with_features(flows(spark, sf), "bytes").select("features", F.col("octets").cast("double").alias("label"))
    shape = L.model_shape(DecisionTreeRegressor(maxDepth=1, maxBins=256).fit(data))
    place = max(range(len(shape["importances"])), key=shape["importances"].__getitem__)
    return spark.createDataFrame([(place, round(shape["importances"][place], 9), shape["depth_max"], shape["leaves_mean"])],
                                 "feature int, importance double, depth double, leaves double")


# models of the grid are stood in for by the prediction times a factor that moves with the position
_FACTORS = 6
_GRID_PREDICTION = "predicted * (1 + ((pos * 31 + {i} * 17) % 7) * {i} / cast(10 as double))"


@query("tune_grid", with_flows(f""", g as (select *, {PREDICTED} as predicted from f),
  m as (select model, octets, {_GRID_PREDICTION.format(i='model')} as p from g, (select unnest(generate_series(0, {_FACTORS - 1})) as model)),
  th as (select cast(cast(64 as bigint) << i as double) as threshold from range(25) r(i)),
  cu as (select model, threshold, cast(sum(case when p > threshold then octets else 0 end) as double) / cast(sum(octets) as double) as x,
      cast(count(*) as double) / count(*) filter (where p > threshold) as r from m, th group by all having count(*) filter (where p > threshold) > 0),
  kn as (select model, x, min(r) as r from cu group by all),
  nb as (select model, (select max(x) from kn k where k.model = t.model and x <= 0.8::double) as lo,
    (select min(x) from kn k where k.model = t.model and x > 0.8::double) as hi from (select distinct model from kn) t)
  select cast(nb.model as int) as model, round(case when lo = 0.8::double or hi is null then a.r else a.r + (0.8::double - lo) * (b.r - a.r) / (hi - lo) end, 6) as score
  from nb left join kn a on a.model = nb.model and a.x = lo left join kn b on b.model = nb.model and b.x = hi"""))
def tune_grid(spark, sf):
    """Scores of six grid points from one pass over an array of predictions."""
    predictions = F.array(*[F.expr(_GRID_PREDICTION.format(i=i)) for i in range(_FACTORS)])
    scored = L.tune_scores(predicted_flows(spark, sf).select("octets", predictions.alias("predictions")))
    return scored.select("model", F.round("score", 6).alias("score"))


# --- pseudonyms, frames


@query("anon_prefixes", with_flows(""", a as (select address, count(*) as uses from (select sa3 as address from f union all select da3 from f) group by 1),
  l as (select address, uses, lag(address) over (order by address) as b from a)
  select address, uses, cast(case when b is null then 32 else length(bin(xor(address, b))) - 1 end as int) as blocks from l"""))
def anon_prefixes(spark, sf):
    """Distinct addresses with their uses and the blocks enciphered for each: one per prefix that no lesser address has."""
    names = A.addresses(flows(spark, sf))
    return A.pseudonyms(names, KEY).select("address", "uses", F.col("blocks").cast("int").alias("blocks"))


@query("anon_single", with_flows(" select address from (select sa3 as address from f union select da3 from f)"))
def anon_single(spark, sf):
    """Addresses whose pseudonym from the shared prefixes equals the one enciphered by itself: all of them."""
    names = A.pseudonyms(A.addresses(flows(spark, sf)), KEY)
    return names.filter(F.col("pseudonym") == A.pseudonym(spark, F.col("address"), KEY)).select("address")


_UNIT_NORMAL = """ select bin_lo, flows_sum, """ + ", ".join(
    f"cast({m}_sum as double) / gap / cast(sum({m}_sum) over () as double) as {m}_pdf" for m in D.METRICS) + """
  from (select *, coalesce(lead(bin_lo) over o - bin_lo, bin_lo - lag(bin_lo) over o) as gap from h window o as (order by bin_lo))"""


@query("pdf_normalized_unit", with_flows(SIZE_UNIT + _UNIT_NORMAL))
def pdf_normalized_unit(spark, sf):
    return D.pdf_points(H.hist(flows(spark, sf), "size"), normalize=True)


@query("coverage_sampling_unit", with_flows(SIZE_UNIT + _SAMPLING.format(missed=_MISSED_SIZE) + _finish_sql("q", "p")))
def coverage_sampling_unit(spark, sf):
    return _finish(C.coverage_sampling(H.hist(flows(spark, sf), "size"), "size"), ["p"])


@query("detect_kind", with_flows(""" select 'packets' as what, case min(packets) when 1 then 'length' when 64 then 'size' end as kind from f
  union all select 'octets', case min(greatest(octets - 64, 64)) when 1 then 'length' when 64 then 'size' end from f"""))
def detect_kind(spark, sf):
    rows = flows(spark, sf)
    padded = rows.withColumn("octets", F.greatest(F.col("octets") - 64, F.lit(64)))
    kinds = [("packets", H.detect_x_value(H.hist(rows, "length", 12))), ("octets", H.detect_x_value(H.hist(padded, "size", 12)))]
    return spark.createDataFrame(kinds, "what string, kind string")


@query("flatten_rows", with_flows(" select value, count(*) as n from (select unnest([pos, packets, octets]) as value from f) group by 1"))
def flatten_rows(spark, sf):
    return flatten(flows(spark, sf).select("pos", "packets", "octets")).groupBy("value").agg(F.count("*").alias("n"))

