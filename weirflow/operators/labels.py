"""Labels and samples of the largest flows, and folds.

A label never needs flows in one global order: running sums go over distinct sizes in size buckets, which yields one
cut size; only the flows of exactly that size are told apart, by position. Labels are then a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import flowcols as fc
from weirflow.functions.flowcols import idiv
from weirflow.functions.hashing import HASH_BITS, hash_bits
from weirflow.operators.positions import nth_positions_by
from weirflow.session import freeze

SIZE_BUCKET_EXP = 12
HASH_BUCKET = 1 << (HASH_BITS - 14)


@dataclass(frozen=True)
class Cut:
    """The flows before a place in the order (octets descending, pos ascending)."""

    octets: int | None  # None: nothing is before the cut
    pos: int | None  # last position that counts among flows of exactly `octets`; -1 none of them

    def column(self, octets: str = "octets", pos: str = "pos") -> Column:
        if self.octets is None:
            return F.lit(False)
        larger = F.col(octets) > self.octets
        if self.pos is not None and self.pos < 0:
            return larger
        tie = F.col(octets) == self.octets
        return larger | (tie if self.pos is None else tie & (F.col(pos) <= self.pos))


def size_profile(flows: DataFrame) -> DataFrame:
    """Distinct flow sizes with their number of flows, written out because the cuts read it several times."""
    return freeze(flows.groupBy("octets").agg(F.count("*").alias("n")))


def _cuts(flows: DataFrame, sizes: DataFrame, measure: Column, targets_of: Callable[[int], Sequence[float]],
          unit_of: Callable[[int], int], pos: str) -> list[Cut]:
    """Cut after the last flow whose running measure, taken from the largest flow down, stays below each target."""
    bucket = fc.bin_low(F.col("octets"), SIZE_BUCKET_EXP)
    s = sizes.withColumn("_m", measure).withColumn("_bucket", bucket)
    total = s.agg(F.sum("_m")).first()[0] or 0
    targets = list(targets_of(total))
    open_targets = [t for t in targets if 0 < t <= total]
    hits = []
    if open_targets:
        wanted = F.array(*[F.lit(t) for t in open_targets])

        def crossing(upto: str, own: str) -> Column:
            return F.exists(wanted, lambda t: (F.col(upto) >= t) & (F.col(upto) - F.col(own) < t))

        down = Window.orderBy(F.desc("_bucket"))
        buckets = s.groupBy("_bucket").agg(F.sum("_m").alias("_b")).withColumn("_upto", F.sum("_b").over(down))
        carried = buckets.filter(crossing("_upto", "_b")).select("_bucket", (F.col("_upto") - F.col("_b")).alias("_carry"))  # one per target at most
        inner = Window.partitionBy("_bucket").orderBy(F.desc("octets"))
        hits = (
            s.join(F.broadcast(carried), "_bucket")
            .withColumn("_upto", F.sum("_m").over(inner) + F.col("_carry"))
            .filter(crossing("_upto", "_m")).select("octets", "n", "_m", "_upto").collect()
        )
    cuts: list[Cut | tuple[int, int]] = []
    for t in targets:
        if t <= 0:
            cuts.append(Cut(None, None))
            continue
        if t > total:
            cuts.append(Cut(-1, None))
            continue
        hit = next(h for h in hits if h["_upto"] >= t > h["_upto"] - h["_m"])
        before, unit = hit["_upto"] - hit["_m"], unit_of(hit["octets"])
        ties = int((t - before) // unit)
        while ties > 0 and before + ties * unit >= t:
            ties -= 1
        while before + (ties + 1) * unit < t:
            ties += 1
        if ties == 0:
            cuts.append(Cut(hit["octets"], -1))
        elif ties >= hit["n"]:
            cuts.append(Cut(hit["octets"], None))
        else:
            cuts.append((hit["octets"], ties - 1))  # the cut lies among equal flows: told apart below, all targets together
    last = nth_positions_by(flows, "octets", [c for c in cuts if not isinstance(c, Cut)], pos)
    return [c if isinstance(c, Cut) else Cut(c[0], last[c]) for c in cuts]


def coverage_cuts(flows: DataFrame, coverages: Sequence[float], pos: str = "pos",
                  sizes: DataFrame | None = None) -> list[Cut]:
    """For each coverage the largest flows whose running octets stay below that share of all octets."""
    sizes = size_profile(flows) if sizes is None else sizes
    return _cuts(flows, sizes, F.col("n") * F.col("octets"), lambda total: [total * c for c in coverages],
                 lambda octets: octets, pos)


def label_coverage(flows: DataFrame, coverage: float, pos: str = "pos") -> DataFrame:
    """`decision` is true for the flows that a perfect heavy-hitter policy of this traffic coverage selects."""
    return flows.withColumn("decision", coverage_cuts(flows, [coverage], pos)[0].column(pos=pos))


def top_cut(flows: DataFrame, count: int, pos: str = "pos", sizes: DataFrame | None = None) -> Cut:
    """The `count` largest flows."""
    sizes = size_profile(flows) if sizes is None else sizes
    return _cuts(flows, sizes, F.col("n"), lambda total: [count + 1 if count < total else total + 1],
                 lambda octets: 1, pos)[0] if count > 0 else Cut(None, None)


def draw_column(seed: int = 0, pos: str = "pos") -> Column:
    """The number by which `top_sample` draws a flow; it depends on the seed and the position only, so that all folds share it."""
    return hash_bits(seed, F.col(pos))


def top_sample(flows: DataFrame, ratio: float, seed: int = 0, pos: str = "pos", total: int | None = None,
               draw: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Half of `ratio` of the flows: the largest; the other half: as many drawn from the rest, without replacement.

    The draw keeps the lowest hash ranks, found by counting hashes per bucket; both halves are filters. `draw` names a
    column that already holds `draw_column`, `sizes` a size profile of the flows.
    """
    sizes = size_profile(flows) if sizes is None else sizes
    if total is None:
        total = sizes.agg(F.sum("n")).first()[0] or 0
    half = int(total * ratio / 2)
    if half == 0:
        return flows.filter(F.lit(False))
    top = top_cut(flows, half, pos, sizes).column(pos=pos)
    h = draw_column(seed, pos) if draw is None else F.col(draw)
    rest = flows.filter(~top).select(pos, h.alias("_h"))
    per_bucket = rest.groupBy(idiv(F.col("_h"), HASH_BUCKET).alias("_b")).agg(F.count("*").alias("_n"))
    hit = (
        per_bucket.withColumn("_upto", F.sum("_n").over(Window.orderBy("_b")))
        .filter((F.col("_upto") >= half) & (F.col("_upto") - F.col("_n") < half)).first()
    )
    if hit is None:
        return flows
    low = hit["_b"] * HASH_BUCKET
    last = (
        rest.filter((F.col("_h") >= low) & (F.col("_h") < low + HASH_BUCKET)).orderBy("_h", pos)
        .offset(half - 1 - (hit["_upto"] - hit["_n"])).limit(1).first()
    )
    drawn = (h < last["_h"]) | ((h == last["_h"]) & (F.col(pos) <= last[pos]))
    return flows.filter(top | drawn)


def fold_column(n: int, folds: int, pos: str = "pos") -> Column:
    """Contiguous folds; the first `n % folds` hold one row more."""
    small, longer = divmod(n, folds)
    border = longer * (small + 1)
    p = F.col(pos)
    if small == 0:
        return p.cast("int")
    return F.when(p < border, idiv(p, small + 1)).otherwise(idiv(p - border, small) + longer).cast("int")


def with_folds(flows: DataFrame, folds: int = 5, pos: str = "pos") -> DataFrame:
    return flows.withColumn("fold", fold_column(flows.count(), folds, pos))


def fold_sizes(tagged: DataFrame) -> Callable[[Column], DataFrame]:
    """Size profiles of any folds, as `size_profile` of these flows, from one pass over all of them."""
    every = freeze(tagged.groupBy("fold", "octets").agg(F.count("*").alias("n")))
    return lambda chosen: freeze(every.filter(chosen).groupBy("octets").agg(F.sum("n").alias("n")))


def top_split(flows: DataFrame, folds: int, ratio: float, seed: int = 0, pos: str = "pos", draw: str | None = None):
    """Yield `(fold, train sample, test)`; the sample holds large and random flows of the other folds."""
    tagged = with_folds(flows, folds, pos)
    sizes = fold_sizes(tagged)
    for k in range(folds):
        others = F.col("fold") != k
        yield k, top_sample(tagged.filter(others), ratio, seed, pos, draw=draw, sizes=sizes(others)), tagged.filter(F.col("fold") == k)
