"""Queries on pseudonyms, mixtures and synthetic flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weirflow.operators import anonymize as A
from weirflow.operators import coverage_mixture as CM
from weirflow.operators import distribution as D
from weirflow.operators import fitting as FIT
from weirflow.operators import generate as G
from weirflow.operators import histogram as H
from weirflow.operators import mixture as M
from weirflow.plans.distribution_queries import LENGTH, SIZE
from weirflow.plans.fixtures import flows, with_flows
from weirflow.plans.registry import query

KEY = "weirflow-queries-need-some-key-1"


@query("anonymize")
def anonymize(spark, sf):
    return A.anonymize(flows(spark, sf), KEY)


@query("anon_dictionary")
def anon_dictionary(spark, sf):
    return A.dictionary(flows(spark, sf), KEY)


PREFIXES = (8, 16, 20, 24, 28, 32)
_PREFIX_SQL = " union all ".join(
    f"select '{c}' as field, {p} as prefix, n, count(*) as groups from (select count(*) as n from f group by {c} >> {32 - p}) group by n"
    for c in ("sa3", "da3") for p in PREFIXES)


@query("anonymize_prefixes", with_flows(f" select field, prefix, n, groups from ({_PREFIX_SQL})"))
def anonymize_prefixes(spark, sf):
    """Sizes of the groups that share a prefix: pseudonyms keep them, whatever the key."""
    rows = A.anonymize(flows(spark, sf), KEY).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(p).alias("prefix"), F.shiftright(c, 32 - p).alias("group"))
        for c in ("sa3", "da3") for p in PREFIXES])).alias("g")).select("g.*")
    sizes = rows.groupBy("field", "prefix", "group").agg(F.count("*").alias("n"))
    return sizes.groupBy("field", "prefix", "n").agg(F.count("*").alias("groups"))


@query("anonymize_rest", with_flows("""
  select pos, prot, sp, dp, "first", first_ms, "last", last_ms, packets, octets, sa3 = lag(sa3) over (order by pos) as same from f"""))
def anonymize_rest(spark, sf):
    """All other columns are kept, and equal neighbours in `pos` stay equal."""
    rows = A.anonymize(flows(spark, sf), KEY)
    before = rows.select((F.col("pos") + 1).alias("pos"), F.col("sa3").alias("b"))
    return rows.join(before, "pos", "left").select(
        "pos", "prot", "sp", "dp", "first", "first_ms", "last", "last_ms", "packets", "octets", (F.col("sa3") == F.col("b")).alias("same"))


# --- mixtures

CLOSED = [
    M.Component(0.3, "uniform", (0.0, 8.0)),
    M.Component(0.5, "genpareto", (1.45, 1.0, 23.2)),
    M.Component(0.2, "weibull_min", (0.75, 0.0, 900.0)),
]
MIXED = [
    M.Component(0.4, "uniform", (0.0, 6.0)), M.Component(0.3, "lognorm", (2.0, 0.0, 20.0)),
    M.Component(0.2, "gamma", (5.0, 0.0, 200.0)), M.Component(0.1, "norm", (900.0, 150.0)),
]


def _bins(spark, sf):
    return H.hist(flows(spark, sf), "length", 12).select(F.col("bin_lo").cast("double").alias("x"))


_CLOSED_SQL = """0.3::double * least(greatest(v / 8, 0), 1)
  + 0.5::double * (1 - pow(1 + 1.45::double * greatest((v - 1) / 23.2::double, 0), -1 / 1.45::double))
  + 0.2::double * (1 - exp(-pow(v / 900, 0.75::double)))"""
_CLOSED_DENSITY = """0.5::double * pow(1 + 1.45::double * (x - 1) / 23.2::double, -1 / 1.45::double - 1) / 23.2::double
  + 0.2::double * 0.75::double * pow(x / 900, -0.25::double) * exp(-pow(x / 900, 0.75::double)) / 900"""


@query("mixture_cdf_closed", with_flows(LENGTH + f""", p as (select cast(bin_lo as double) as x from h),
  c as (select x, (select {_CLOSED_SQL} from (select x as v)) as hi, (select {_CLOSED_SQL} from (select case when x = 1 then 0 else x - 1 end as v)) as lo from p)
  select x, round(hi, 9) as cdf, round(case when x < 1024 then hi - lo else {_CLOSED_DENSITY} end, 9) as pdf from c"""))
def mixture_cdf_closed(spark, sf):
    x = F.col("x")
    return _bins(spark, sf).select("x", F.round(M.mix_cdf(CLOSED, x), 9).alias("cdf"), F.round(M.mix_pdf(CLOSED, x), 9).alias("pdf"))


@query("mixture_cdf")
def mixture_cdf(spark, sf):
    return _bins(spark, sf).select("x", M.mix_cdf(MIXED, F.col("x")).alias("cdf"))


@query("mixture_pdf")
def mixture_pdf(spark, sf):
    return _bins(spark, sf).select("x", M.mix_pdf(MIXED, F.col("x")).alias("pdf"))


@query("mixture_components")
def mixture_components(spark, sf):
    return M.components(_bins(spark, sf), MIXED)


def fitted(spark, sf, x_value: str = "length", iterations: int = 20):
    """Mixtures of flows, packets and octets fitted to the table."""
    h = H.hist(flows(spark, sf), x_value, 12)
    start = {"uniform": 6, "lognorm": 4} if x_value == "length" else {"pareto": 1, "lognorm": 4}
    return FIT.fit_many(h, {m: start for m in D.METRICS}, iterations)


@query("mixture_fit")
def mixture_fit(spark, sf):
    return M.mixture_frame(spark, fitted(spark, sf, iterations=30))


def _em_sql(iterations: int) -> str:
    """Iterations of two nested uniforms and a Pareto tail, one CTE pair each."""
    out = """, b as (select cast(bin_lo as double) as x, cast(flows_sum as double) as ws, avg(cast(flows_sum as double)) over () as mean from h),
  m0 as (select 0.1::double as w1, 0.1::double as w2, 0.1::double as w3, 1.0::double as c, 10.0::double as s)"""
    for i in range(iterations):
        out += f""", p{i} as (select x, ws / mean as t, case when x <= 1 then w1 else 0 end as a, case when x <= 2 then w2 / 2 else 0 end as b,
      case when x >= 2 then w3 * pow(1 + c * (x - 2) / s, -1 / c - 1) / s else 0 end as g from b, m{i}),
  m{i + 1} as (select avg(t * a / n) as w1, avg(t * b / n) as w2, avg(t * g / n) as w3,
      sum(t * g / n * ln(x)) / sum(t * g / n) - ln(2) as c, 2 * (sum(t * g / n * ln(x)) / sum(t * g / n) - ln(2)) as s
    from (select *, case when a + b + g = 0 then 1 else a + b + g end as n from p{i}))"""
    return out


@query("mixture_fit_closed", with_flows(LENGTH + _em_sql(5) + """ select component, round(weight, 9) as weight, dist, round(shape, 9) as shape from (
  select 0 as component, w1 as weight, 'uniform' as dist, 0::double as shape from m5 union all select 1, w2, 'uniform', 0 from m5
  union all select 2, w3, 'genpareto', c from m5)"""))
def mixture_fit_closed(spark, sf):
    h = H.hist(flows(spark, sf), "length", 12)
    fit = FIT.fit_many(h, {"flows": {"uniform": 2, "pareto": 1}}, 5)
    return M.mixture_frame(spark, fit).select(
        "component", F.round("weight", 9).alias("weight"), "dist", F.round(F.col("params")[0], 9).alias("shape"))


@query("mixture_fit_gamma_weibull")
def mixture_fit_gamma_weibull(spark, sf):
    h = H.hist(flows(spark, sf), "length", 12)
    starts = [M.Component(0.1, "gamma", (2.0, 0.0, 12.0)), M.Component(0.1, "weibull_min", (0.9, 0.0, 20000.0))]
    return M.mixture_frame(spark, FIT.fit_many(h, {"flows": starts}, 10))


@query("mixture_avg")
def mixture_avg(spark, sf):
    mixtures = fitted(spark, sf)
    x = F.col("x")
    return _bins(spark, sf).select("x", *[M.mix_average(mixtures, x, w).alias(w) for w in ("packets", "octets", "packet_size")])


@query("mixture_sample")
def mixture_sample(spark, sf):
    total, mix = fitted(spark, sf)["flows"]
    return M.sample(spark, mix, total, seed=11)


_DRAWS = ", ".join(f"cast('0x' || substr(md5('13{t}:' || id), 1, 13) as bigint) / 4503599627370496::double as {t}" for t in "uw")


@query("mixture_sample_closed", with_flows(f""", n as (select count(*) as n from f), s as (select id, {_DRAWS}
    from (select unnest(generate_series(0, n - 1)) as id from n))
  select id, cast(trunc(case when w < 0.3::double then 8 * u when w < 0.8::double then 1 + 23.2::double * (pow(1 - u, -1.45::double) - 1) / 1.45::double
    else 900 * pow(-ln(1 - u), 1 / 0.75::double) end) as bigint) + 1 as x from s"""))
def mixture_sample_closed(spark, sf):
    return M.sample(spark, CLOSED, flows(spark, sf).count(), seed=13)


@query("generate_mixture")
def generate_mixture(spark, sf):
    mixtures = fitted(spark, sf)
    return G.sample_mixture(spark, mixtures, mixtures["flows"][0], seed=12)


@query("reduction_mixture")
def reduction_mixture(spark, sf):
    return CM.reduction_mixture(spark, fitted(spark, sf, "size"))


@query("coverage_mixture")
def coverage_mixture(spark, sf):
    mixtures = fitted(spark, sf)
    curves = []
    for method in ("first", "threshold", "sampling"):
        c = CM.coverage_mixture(spark, mixtures, method)
        level = F.col(c.columns[0]).cast("double").alias("level")
        curves.append(c.select(F.lit(method).alias("method"), level, *c.columns[1:]))
    return reduce(lambda a, b: a.unionByName(b), curves)


# --- generation


def _uniform_sql(seed: str, key: str) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || {key}), 1, 13) as bigint) / 4503599627370496::double"


_LINE = """, t as (select cast(sum(flows_sum) as bigint) as total from h),
  ln as (select bin_lo as x, octets_sum / packets_sum as ps, flows_sum, cast(sum(flows_sum) over (order by bin_lo) as bigint) as hi from h)"""


def _complete_sql(x_value: str) -> str:
    def rnd(v):
        return f"cast(case when u + floor({v}) >= {v} then floor({v}) else floor({v}) + 1 end as bigint)"

    if x_value == "length":
        octets = "(x * least(greatest(ps, 64), 1522))"
        return f"x as packets, {rnd(octets)} as octets"
    packets = "greatest(case when x / ceil(x / ps) < 64 then floor(x / ps) else x / ps end, 1)"
    return f"{rnd(packets)} as packets, x as octets"


def _sample_sql(seed: int, x_value: str) -> str:
    return f"""{_LINE}, s as (select id, cast(floor({_uniform_sql(str(seed), 'id')} * total) as bigint) as t,
      {_uniform_sql(f'{seed}r', 'id')} as u from t, (select unnest(generate_series(0, total - 1)) as id from t)),
  j as (select id, u, x, ps from s asof join (select *, hi - flows_sum as lo from ln) b on s.t >= b.lo)
  select id, {_complete_sql(x_value)} from j"""


@query("generate_sample", with_flows(LENGTH + _sample_sql(21, "length")))
def generate_sample(spark, sf):
    h = H.hist(flows(spark, sf), "length", 12)
    return G.sample_histogram(h, h.agg(F.sum("flows_sum")).first()[0], "length", 21)


@query("generate_size", with_flows(SIZE + _sample_sql(22, "size")))
def generate_size(spark, sf):
    h = H.hist(flows(spark, sf), "size", 12)
    return G.sample_histogram(h, h.agg(F.sum("flows_sum")).first()[0], "size", 22)


@query("generate_expand", with_flows(LENGTH + f""", e as (select bin_lo as x, octets_sum / packets_sum as ps,
    unnest(generate_series(0, flows_sum - 1)) as "copy" from h),
  r as (select *, {_uniform_sql('23', 'x || \':\' || "copy"')} as u from e) select x, "copy", {_complete_sql('length')} from r"""))
def generate_expand(spark, sf):
    return G.expand_histogram(H.hist(flows(spark, sf), "length", 12), "length", 23)


def _generated_sql(seed: int) -> str:
    head, tail = _sample_sql(seed, "length").rsplit("select id,", 1)
    return f"""{head}, g as (select {tail})
  select packets, octets, count(*) as flows, cast(0 as bigint) as others from g group by 1, 2"""


@query("generate_flows", with_flows(LENGTH + _generated_sql(24)))
def generate_flows(spark, sf):
    """Generated flow records by their packets and octets, and what their other fields add up to."""
    h = H.hist(flows(spark, sf), "length", 12)
    rows = G.to_flows(G.sample_histogram(h, h.agg(F.sum("flows_sum")).first()[0], "length", 24))
    rest = [c for c in rows.columns if c not in ("packets", "octets")]
    return rows.groupBy("packets", "octets").agg(
        F.count("*").alias("flows"), F.sum(F.greatest(*[F.abs(F.col(c)).cast("long") for c in rest])).alias("others"))
