"""Mixtures of distributions: CDF, PDF, averages and sampling as expressions over a column.

A mixture is a short list of components, i.e. parameters rather than data. Parameters follow the usual
shape/location/scale order of each distribution.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.hashing import uniform
from weirflow.functions.special import gamma_cdf, normal_cdf

# PDFs below this x are CDF differences; least size and length; least and greatest packet
EXACT_BELOW = 1024
FIRST_X = {"length": 1, "size": 64}

MIXTURE_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("sum", T.LongType()),
    T.StructField("component", T.IntegerType()), T.StructField("weight", T.DoubleType()),
    T.StructField("dist", T.StringType()), T.StructField("params", T.ArrayType(T.DoubleType())),
])


class Component(NamedTuple):
    weight: float
    dist: str
    params: tuple[float, ...]


Mixture = Sequence[Component]


def normalized(mix: Mixture) -> list[Component]:
    total = sum(c.weight for c in mix)
    return [Component(c.weight / total, c.dist, tuple(c.params)) for c in mix]


def mixture_frame(spark: SparkSession, mixtures: dict[str, tuple[int, Mixture]]) -> DataFrame:
    rows = [(m, int(s), i, float(c.weight), c.dist, [float(p) for p in c.params])
            for m, (s, mix) in mixtures.items() for i, c in enumerate(mix)]
    return spark.createDataFrame(rows, MIXTURE_SCHEMA)


def mixtures_of(df: DataFrame) -> dict[str, tuple[int, list[Component]]]:
    """Parameters of a mixture frame (a few rows per metric)."""
    out: dict[str, tuple[int, list[Component]]] = {}
    for r in df.orderBy("metric", "component").collect():
        out.setdefault(r["metric"], (r["sum"], []))[1].append(Component(r["weight"], r["dist"], tuple(r["params"])))
    return out


def _unpack(c: Component) -> tuple[float, float, float]:
    """Shape (0 where there is none), location and scale."""
    if c.dist in ("uniform", "norm"):
        return 0.0, c.params[0], c.params[1]
    return c.params[0], c.params[1], c.params[2]


def scalar_cdf(c: Component, x: float) -> float:
    return float(array_cdf(c, np.array([float(x)]))[0])


def array_cdf(c: Component, x: np.ndarray) -> np.ndarray:
    """CDF of one component, for Arrow batches."""
    shape, loc, scale = _unpack(c)
    z = (np.asarray(x, float) - loc) / scale
    if c.dist == "uniform":
        return np.clip(z, 0, 1)
    if c.dist == "norm":
        return normal_cdf(z)
    p = np.maximum(z, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if c.dist == "lognorm":
            return np.where(p > 0, normal_cdf(np.log(np.where(p > 0, p, 1.0)) / shape), 0.0)
        if c.dist == "gamma":
            return gamma_cdf(p, shape, 1.0)
        if c.dist == "weibull_min":
            return -np.expm1(-(p ** shape))
        if c.dist == "genpareto":
            if shape == 0:
                return -np.expm1(-p)
            return 1 - np.maximum(1 + shape * p, 0.0) ** (-1 / shape)
    raise ValueError(f"unknown distribution {c.dist}")


CLOSED = ("uniform", "weibull_min", "genpareto")


def component_cdf(c: Component, x: Column) -> Column:
    """JVM-side where there is a closed form; error function and incomplete gamma run in Arrow batches."""
    if c.dist not in CLOSED:
        return _numeric_cdf([Component(1.0, c.dist, tuple(c.params))])(x.cast("double"))
    shape, loc, scale = _unpack(c)
    z = (x - F.lit(float(loc))) / F.lit(float(scale))
    if c.dist == "uniform":
        return F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0))
    p = F.greatest(z, F.lit(0.0))
    if c.dist == "weibull_min":
        return -F.expm1(-F.pow(p, F.lit(float(shape))))
    if shape == 0:
        return -F.expm1(-p)
    return 1 - F.pow(F.greatest(1 + F.lit(float(shape)) * p, F.lit(0.0)), F.lit(-1.0 / shape))


def _numeric_cdf(parts: list[Component]):
    @F.pandas_udf("double")
    def weighted_cdf(x: pd.Series) -> pd.Series:
        v, where = np.unique(x.to_numpy(float), return_inverse=True)
        total = np.zeros(len(v))
        for c in parts:
            total += c.weight * array_cdf(c, v)
        return pd.Series(total[where])

    return weighted_cdf


def mix_cdf(mix: Mixture, x: Column) -> Column:
    """CDF of a mixture; all components without closed form share one batch function."""
    parts = normalized(mix)
    out = F.lit(0.0)
    for c in parts:
        if c.dist in CLOSED:
            out = out + F.lit(c.weight) * component_cdf(c, x)
    numeric = [c for c in parts if c.dist not in CLOSED]
    return out + _numeric_cdf(numeric)(x.cast("double")) if numeric else out


def component_density(c: Component, x: Column) -> Column:
    """Density, entirely JVM-side: constants that need lgamma are computed with the plan."""
    shape, loc, scale = _unpack(c)
    z = (x - F.lit(float(loc))) / F.lit(float(scale))
    inv = F.lit(1.0 / scale)
    if c.dist == "uniform":
        return F.when((z >= 0) & (z <= 1), inv).otherwise(0.0)
    if c.dist == "norm":
        return F.exp(-z * z / 2) * F.lit(1 / (scale * math.sqrt(2 * math.pi)))
    k = F.lit(float(shape))
    if c.dist == "lognorm":
        d = F.exp(-F.pow(F.log(z) / k, F.lit(2.0)) / 2) / (z * F.lit(scale * shape * math.sqrt(2 * math.pi)))
    elif c.dist == "gamma":
        d = F.exp((k - 1) * F.log(z) - z - F.lit(math.lgamma(shape))) * inv
    elif c.dist == "weibull_min":
        d = k * F.pow(z, k - 1) * F.exp(-F.pow(z, k)) * inv
    elif c.dist == "genpareto":
        inner = 1 + k * z
        d = F.exp(-z) * inv if shape == 0 else F.when(inner > 0, F.pow(inner, F.lit(-1.0 / shape - 1)) * inv).otherwise(0.0)
        return F.when(z >= 0, d).otherwise(0.0)
    else:
        raise ValueError(f"unknown distribution {c.dist}")
    return F.when(z > 0, d).otherwise(0.0)


def _before(x: Column, x_value: str) -> Column:
    return F.when(x == FIRST_X.get(x_value, 1), F.lit(0.0)).otherwise(x - 1.0)


def component_pdf(c: Component, x: Column, x_value: str = "length") -> Column:
    """Probability of the integer x while x is small, density beyond."""
    step = component_cdf(c, x) - component_cdf(c, _before(x, x_value))
    return F.when(x < EXACT_BELOW, step).otherwise(component_density(c, x))


def mix_pdf(mix: Mixture, x: Column, x_value: str = "length") -> Column:
    density = F.lit(0.0)
    for c in normalized(mix):
        density = density + F.lit(c.weight) * component_density(c, x)
    step = mix_cdf(mix, x) - mix_cdf(mix, _before(x, x_value))
    return F.when(x < EXACT_BELOW, step).otherwise(density)


def components(df: DataFrame, mix: Mixture, x: str = "x", x_value: str = "length") -> DataFrame:
    """Weighted CDF and PDF of each component at the values of `df`, in long form."""
    parts = normalized(mix)
    wide = df.select(x, *[
        col for i, c in enumerate(parts) for col in (
            (F.lit(c.weight) * component_cdf(c, F.col(x))).alias(f"_c{i}"),
            (F.lit(c.weight) * component_pdf(c, F.col(x), x_value)).alias(f"_p{i}"))
    ])
    return wide.select(x, F.inline(F.array(*[
        F.struct(F.lit(i).alias("component"), F.lit(c.dist).alias("dist"), F.col(f"_c{i}").alias("cdf"), F.col(f"_p{i}").alias("pdf"))
        for i, c in enumerate(parts)
    ])))


def mix_average(mixtures: dict[str, tuple[int, Mixture]], x: Column, what: str, x_value: str = "length") -> Column:
    """Average packets or octets per flow, or packet size / inter-arrival time per packet, at x."""
    top, base = {"packets": ("packets", "flows"), "octets": ("octets", "flows"),
                 "packet_size": ("octets", "packets"), "packet_iat": ("duration", "packets")}[what]
    scale = mixtures[top][0] / mixtures[base][0]
    return F.try_divide(F.lit(scale) * mix_pdf(mixtures[top][1], x, x_value), mix_pdf(mixtures[base][1], x, x_value))


TABLE_CELLS = 2048
POLISH_STEPS = 60


def gamma_table(shape: float) -> tuple[np.ndarray, np.ndarray]:
    """Monotone table of the gamma CDF: abscissas from 0 to where it is 1, and its values there."""
    top = shape + 40 * math.sqrt(shape) + 800.0
    middle = max(shape, 1.0)
    least = 1e-300 if shape < 1 else middle * 1e-12
    t = np.unique(np.concatenate([
        [0.0], np.geomspace(least, middle / 8, TABLE_CELLS // 4), np.linspace(middle / 8, middle + 12 * math.sqrt(middle) + 12, TABLE_CELLS),
        np.geomspace(middle + 1, top, TABLE_CELLS // 4)]))
    return t, np.maximum.accumulate(gamma_cdf(t, shape, 1.0))


def gamma_quantile(q: np.ndarray, shape: float, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inverse of the gamma CDF at scale 1: a cell of the table, then Newton steps that stay inside what brackets the root."""
    t, f = table
    cell = np.clip(np.searchsorted(f, q, side="left"), 1, len(t) - 1)
    low, high = t[cell - 1], t[cell]
    rise = f[cell] - f[cell - 1]
    x = low + (high - low) * np.where(rise > 0, (q - f[cell - 1]) / np.where(rise > 0, rise, 1), 0.5)
    norm, open_ = math.lgamma(shape), np.arange(len(q))
    for _ in range(POLISH_STEPS):
        at = x[open_]
        error = gamma_cdf(at, shape, 1.0) - q[open_]
        below = error < 0
        low[open_], high[open_] = np.where(below, at, low[open_]), np.where(below, high[open_], at)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            step = error / np.exp((shape - 1) * np.log(at) - at - norm)
        new = at - step
        a, b = low[open_], high[open_]
        new = np.where((new >= a) & (new <= b), new, (a + b) / 2)
        x[open_] = new
        open_ = open_[(np.abs(new - at) > 1e-14 * np.abs(new)) & (error != 0)]
        if not len(open_):
            break
    return x


def _gamma_inverse(shape: float, scale: float):
    table = gamma_table(shape)  # a few thousand numbers

    @F.pandas_udf("double")
    def inverse(u: pd.Series) -> pd.Series:
        return pd.Series(gamma_quantile(u.to_numpy(float), shape, table) * scale)

    return inverse


def component_sample(c: Component, u: Column, v: Column) -> Column:
    """A value of the component from uniforms `u` and `v`."""
    shape, loc, scale = _unpack(c)
    lo, sc = F.lit(float(loc)), F.lit(float(scale))
    if c.dist == "uniform":
        return lo + sc * u
    if c.dist == "genpareto":
        return lo + sc * (-F.log1p(-u) if shape == 0 else F.expm1(-F.lit(float(shape)) * F.log1p(-u)) / F.lit(float(shape)))
    if c.dist == "weibull_min":
        return lo + sc * F.pow(-F.log1p(-u), F.lit(1.0 / shape))
    if c.dist == "gamma":
        return lo + _gamma_inverse(shape, scale)(u)
    normal = F.sqrt(-2 * F.log1p(-u)) * F.cos(v * (2 * math.pi))
    return lo + sc * normal if c.dist == "norm" else lo + sc * F.exp(F.lit(float(shape)) * normal)


def sample(spark: SparkSession, mix: Mixture, n: int, x_value: str = "length", seed: int = 0,
           rows_per_task: int = 5_000_000) -> DataFrame:
    """`n` values `(id, x)`: whole values from 1 (64 for sizes), repeatable from the seed.

    A value beyond the range of a long fails the job, as heavy tails are not cut: sample such a mixture as doubles
    (`x_value` neither length nor size) and decide there.
    """
    parts = max(spark.sparkContext.defaultParallelism, -(-n // rows_per_task))
    ids = spark.range(0, n, 1, parts)
    u, v, w = (uniform(f"{seed}{tag}", F.col("id")) for tag in "uvw")
    rows = ids.select("id", u.alias("u"), v.alias("v"), w.alias("w"))
    mix = normalized(mix)
    value = component_sample(mix[-1], F.col("u"), F.col("v"))
    for c, upper in reversed(list(zip(mix[:-1], accumulate(c.weight for c in mix)))):
        value = F.when(F.col("w") < F.lit(upper), component_sample(c, F.col("u"), F.col("v"))).otherwise(value)
    if x_value in FIRST_X:
        value = F.when(value < 2.0**63 - 1024, value.cast("long") + 1).otherwise(F.raise_error("a sampled value exceeds a long").cast("long"))
        if x_value == "size":
            value = F.greatest(value, F.lit(FIRST_X["size"]).cast("long"))
    return rows.select("id", value.alias("x"))
