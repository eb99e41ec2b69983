"""Expectation maximisation of mixtures on a histogram.

The whole fit is one barrier stage: every task holds a part of the bins, computes responsibilities under the current
parameters and a small matrix of weighted moments, and all tasks exchange these matrices, so each has the new parameters.
Bins never leave the executors. Where barrier stages are refused (dynamic allocation), an iteration is one job that
returns the same matrices to the driver.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.special import digamma, trigamma
from weirflow.operators.mixture import Component, scalar_cdf
from weirflow.session import freeze

EPS = float(np.finfo(float).eps)
START_WEIGHT = 0.1
BINS_PER_BLOCK = 200_000  # bins of one task, as long as there are task slots for more
NEWTON_STEPS = 5


def initial_mixture(low: float, high: float, uniform: int = 0, pareto: int = 0, lognorm: int = 0) -> list[Component]:
    """Start: nested uniforms at the low end, Pareto and lognormal parts spread geometrically over the range."""
    start = low + max(uniform, 1) - 1
    n = pareto + lognorm
    centres = [start * (high / start) ** (i / (n - 1)) if n > 1 else start for i in range(n)]
    mix = [Component(START_WEIGHT, "uniform", (0.0, low + i)) for i in range(uniform)]
    nxt = iter(centres)
    for i in range(pareto):
        edge = low + uniform - 1 if i == 0 else next(nxt)
        mix.append(Component(START_WEIGHT, "genpareto", (1.0, edge, 10.0)))
    mix += [Component(START_WEIGHT, "lognorm", (2.0, 0.0, next(nxt))) for _ in range(lognorm)]
    return mix


def _density(c: Component, x: np.ndarray, lnx: np.ndarray) -> np.ndarray:
    if c.dist == "uniform":
        return np.where((x >= c.params[0]) & (x <= c.params[0] + c.params[1]), 1 / c.params[1], 0.0)
    if c.dist == "norm":
        z = (x - c.params[0]) / c.params[1]
        return np.exp(-z * z / 2) / (c.params[1] * math.sqrt(2 * math.pi))
    shape, loc, scale = c.params
    if c.dist == "lognorm":
        z = (lnx - math.log(scale)) / shape
        return np.exp(-z * z / 2 - lnx) / (shape * math.sqrt(2 * math.pi))
    if c.dist == "genpareto":
        z = (x - loc) / scale
        return np.where(z >= 0, np.maximum(1 + shape * np.maximum(z, 0), 0) ** (-1 / shape - 1) / scale, 0.0)
    lnz = lnx - math.log(scale)
    if c.dist == "gamma":
        return np.exp((shape - 1) * lnz - x / scale - math.lgamma(shape)) / scale
    if c.dist == "weibull_min":
        return np.exp((shape - 1) * lnz - np.exp(shape * lnz)) * shape / scale
    raise ValueError(f"unknown distribution {c.dist}")


def _responsibilities(block: np.ndarray, mix: Sequence[Component], first: tuple[float, Sequence[float]]) -> np.ndarray:
    """Shares of the components in each bin times the traffic of the bin, components by bins."""
    x, traffic, lnx = block
    p = np.stack([c.weight * _density(c, x, lnx) for c in mix])
    p[:, x == first[0]] = np.array(first[1])[:, None]
    total = p.sum(axis=0)
    total[total == 0] = 1.0
    return p / total * traffic


def _moments(block: np.ndarray, mix: Sequence[Component], first) -> np.ndarray:
    """Per component: sums of w, w*u, w*u*u for u = ln x (x for norm) around the old centre, w*x, and w*(x/scale)^k."""
    x, _, lnx = block
    r = _responsibilities(block, mix, first)
    out = np.zeros((len(mix), 5))
    out[:, 0] = r.sum(axis=1)
    for i, c in enumerate(mix):
        w = r[i]
        if c.dist == "uniform":
            continue
        u = x - c.params[0] if c.dist == "norm" else lnx - math.log(c.params[2]) if c.dist == "lognorm" else lnx
        out[i, 1], out[i, 2], out[i, 3] = w @ u, w @ (u * u), w @ x
        if c.dist == "weibull_min":
            out[i, 4] = w @ np.exp(c.params[0] * (lnx - math.log(c.params[2])))
    return out


def _weibull_terms(block: np.ndarray, mix, first, trial: dict[int, tuple[float, float]]) -> np.ndarray:
    """Sums of w z^k ln z and w z^k ln^2 z, z = x / l, for trial (k, l) per component."""
    lnx = block[2]
    r = _responsibilities(block, mix, first)
    out = np.zeros((len(mix), 2))
    for i, (k, scale) in trial.items():
        lnz = lnx - math.log(scale)
        t = r[i] * np.exp(k * lnz)
        out[i] = t @ lnz, t @ (lnz * lnz)
    return out


def _gamma_shape(target: float) -> float:
    """Solve digamma(a) = target."""
    a = math.exp(target) + 0.5 if target > -2.2 else -1 / (target + 0.5772156649015329)
    for _ in range(50):
        step = (digamma(a) - target) / trigamma(a)
        a = max(a - step, a / 10)
        if abs(step) < 1e-13 * a:
            break
    return a


class _Fit:
    """State of one mixture during the iterations."""

    def __init__(self, low: float, total: float, mix: Sequence[Component], max_pareto: float | None):
        self.low, self.total, self.max_pareto = low, total, max_pareto
        self.mix = [Component(float(c.weight), c.dist, tuple(float(p) for p in c.params)) for c in mix]

    def first(self) -> tuple[float, list[float]]:
        """The first bin takes all mass from 0 on."""
        return self.low, [c.weight * (scalar_cdf(c, self.low) - scalar_cdf(c, 0.0)) for c in self.mix]

    def edge(self) -> float:
        edges = [c.params[1] if c.dist == "uniform" else c.params[1] + 1 for c in self.mix if c.dist in ("uniform", "genpareto")]
        return max([0.0, *edges])

    def update(self, m: np.ndarray, weibull: dict[int, tuple[float, float]]) -> None:
        edge = self.edge()
        new = []
        for i, c in enumerate(self.mix):
            weight = m[i, 0] / self.total
            if self.max_pareto and c.dist == "genpareto":
                weight = min(weight, self.max_pareto)
            new.append(Component(weight, c.dist, self._params(c, m[i], edge, weibull.get(i))))
        self.mix = new

    def _params(self, c: Component, s: np.ndarray, edge: float, weibull) -> tuple[float, ...]:
        if c.dist == "uniform":
            return c.params
        w = s[0] if s[0] > 0 else EPS
        if c.dist in ("norm", "lognorm"):
            shift = s[1] / w
            sigma = math.sqrt(max(s[2] / w - shift * shift, 0.0)) or EPS
            if c.dist == "norm":
                return c.params[0] + shift, sigma
            scale = c.params[2] * math.exp(shift)
            return c.params if scale < edge else (sigma, 0.0, scale)
        if not s[0] > 0:
            return c.params
        if c.dist == "genpareto":
            tail = s[1] / w - math.log(c.params[1])  # mean log excess over the fixed location
            return (tail, c.params[1], c.params[1] * tail) if tail > 0 else c.params
        if c.dist == "gamma":
            scale = s[3] / w / c.params[0]
            return _gamma_shape(s[1] / w - math.log(scale)), 0.0, scale
        return weibull[0], 0.0, weibull[1]


Total = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]


def _newton_weibull(total: Total, column: int, fit: _Fit, m: np.ndarray) -> dict[int, tuple[float, float]]:
    """Shapes by a few Newton steps, all Weibull components sharing one exchange per step."""
    trial = {}
    for i, c in enumerate(fit.mix):
        if c.dist == "weibull_min" and m[i, 0] > 0:
            scale = c.params[2] * (m[i, 4] / m[i, 0]) ** (1 / c.params[0])
            trial[i] = (1.0, scale)
    for _ in range(NEWTON_STEPS if trial else 0):
        mix, first, now = fit.mix, fit.first(), dict(trial)
        t = total(lambda b: _weibull_terms(b[[0, column, -1]], mix, first, now))
        for i, (k, scale) in now.items():
            w, log_mean = m[i, 0], m[i, 1] - math.log(scale) * m[i, 0]
            value = w / k + log_mean - t[i, 0]
            slope = -w / (k * k) - t[i, 1]
            trial[i] = (max(k - value / slope, k / 10), scale)
    return trial


def _iterate(fits: list[_Fit], total: Total, max_iter: int, keep: bool) -> list[list[list[Component]]]:
    """Run all iterations; the mixtures of every metric after each of them, or only the last."""
    past = [[f.mix for f in fits]]
    for _ in range(max_iter):
        state = [(i + 1, f.mix, f.first()) for i, f in enumerate(fits)]
        sums = total(lambda b: np.concatenate([_moments(b[[0, i, -1]], mix, first) for i, mix, first in state]))
        at = 0
        for i, f in enumerate(fits):
            part = sums[at: at + len(f.mix)]
            at += len(f.mix)
            f.update(part, _newton_weibull(total, i + 1, f, part))
        past = [*past, [f.mix for f in fits]] if keep else [[f.mix for f in fits]]
    return past


def fit_many(histogram: DataFrame, starts: dict[str, Sequence[Component] | dict[str, int]], max_iter: int = 100,
             max_pareto: float | None = None,
             callback: Callable[[str, list[Component], int], None] | None = None,
             barrier: bool | None = None) -> dict[str, tuple[int, list[Component]]]:
    """Fit one mixture per metric (`flows`, `packets`, `octets`) in a single stage.

    Each task holds its bins in memory and the tasks exchange the moment sums of an iteration, a few numbers per
    component, so an iteration costs one exchange and no job. If an executor is lost, the stage starts anew. A histogram
    of up to `BINS_PER_BLOCK` bins is one plain task. `barrier` says whether several tasks may form a barrier stage,
    which needs a slot for each at once (default: unless executors are allocated dynamically).
    `starts` gives a mixture, or the numbers of uniform, pareto and lognorm components to start from.
    Returns `{metric: (sum, mixture)}`; `callback` gets the mixtures of all iterations in order, at the end.
    """
    metrics = list(starts)
    stats = histogram.agg(F.min("bin_lo"), F.max("bin_lo"), F.count("*"), *[F.sum(f"{m}_sum") for m in metrics]).first()
    low, high, rows, totals = stats[0], stats[1], stats[2], stats[3:]
    if not rows:
        raise ValueError("a histogram without bins can't be fitted")
    if low <= 0:
        raise ValueError("bins must lie above 0: the fit uses their logarithm")
    fits = []
    for m, total in zip(metrics, totals):
        start = starts[m]
        fits.append(_Fit(low, float(total), initial_mixture(low, high, **start) if isinstance(start, dict) else start, max_pareto))
    parts = max(1, min(-(-rows // BINS_PER_BLOCK), histogram.sparkSession.sparkContext.defaultParallelism))
    keep = callback is not None

    if barrier is None:
        barrier = histogram.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false") != "true"

    def block_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held = [np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches]
        block = np.concatenate(held, axis=1) if held else np.zeros((len(metrics) + 1, 0))
        return np.vstack([block, np.log(block[:1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of(batches)
        context = BarrierTaskContext.get() if parts > 1 else None

        def total(fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            own = fn(block)
            if context is None:
                return own
            told = context.allGather(base64.b64encode(own.tobytes()).decode())
            return sum(np.frombuffer(base64.b64decode(t), float).reshape(own.shape) for t in told)

        past = _iterate(fits, total, max_iter, keep)
        if context is None or context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"past": pa.array([pickle.dumps(past)], pa.binary())})

    columns = [F.col(c).cast("double") for c in ("bin_lo", *[f"{m}_sum" for m in metrics])]
    bins = histogram.select(*columns).repartition(parts)
    if parts == 1 or barrier:
        done = bins.mapInArrow(run, "past binary", barrier=parts > 1).collect()[0]  # one row; a limit would not start all tasks
        past = pickle.loads(done["past"])
    else:
        frozen = freeze(bins)

        def by_job(fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = fn(block_of(batches))
                yield pa.RecordBatch.from_pydict({"m": pa.array([own.ravel()], pa.list_(pa.float64())), "n": pa.array([own.shape[1]])})

            told = frozen.mapInArrow(sums, "m array<double>, n long").collect()  # a few numbers per task
            return sum(np.array(t["m"]).reshape(-1, t["n"]) for t in told)

        past = _iterate(fits, by_job, max_iter, keep)
    if callback:
        for it, mixes in enumerate(past):
            for m, mix in zip(metrics, mixes):
                callback(m, mix, it)
    return {m: (int(total), mix) for m, total, mix in zip(metrics, totals, past[-1])}


def fit(histogram: DataFrame, y_value: str, start: Sequence[Component] | dict[str, int], max_iter: int = 100,
        max_pareto: float | None = None, callback=None) -> tuple[int, list[Component]]:
    """Fit one metric of a histogram."""
    return fit_many(histogram, {y_value: start}, max_iter, max_pareto, callback)[y_value]


def values_histogram(df: DataFrame, column: str) -> DataFrame:
    """Distinct raw values with their counts, in the shape the fit takes."""
    return df.groupBy(F.col(column).alias("bin_lo")).agg(F.count("*").alias("flows_sum"))
