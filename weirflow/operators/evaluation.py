"""Scores of predicted decisions and statistics over folds and rounds."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.special import t_quantile

COUNTS = ("tn", "fp", "fn", "tp")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """True/false negatives and positives, one row (per group)."""
    t, p = F.col(label).cast("boolean"), F.col(prediction).cast("boolean")
    aggs = [F.count_if(c).alias(n) for n, c in zip(COUNTS, (~t & ~p, ~t & p, t & ~p, t & p))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def class_metrics(df: DataFrame) -> DataFrame:
    """Rates derived from a confusion matrix; null where a denominator is zero."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    d = F.try_divide
    out = df.select(
        "*",
        d(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        d(2 * tp, 2 * tp + fp + fn).alias("true_fscore"),
        d(tp, tp + fn).alias("tpr"), d(fn, tp + fn).alias("fnr"),
        d(fp, fp + tn).alias("fpr"), d(tn, fp + tn).alias("tnr"),
        d(tp, tp + fp).alias("ppv"), d(fp, tp + fp).alias("fdr"),
        d(fn, fn + tn).alias("for"), d(tn, fn + tn).alias("npv"),
        d(tp, tp + fn + fp).alias("ts"),
    )
    return out.select(
        "*",
        (F.col("tpr") + F.col("tnr") - 1).alias("informedness"),
        (F.col("ppv") + F.col("npv") - 1).alias("markedness"),
        (F.sqrt(F.col("tpr") * F.col("tnr") * F.col("ppv") * F.col("npv"))
         - F.sqrt(F.col("fnr") * F.col("fpr") * F.col("for") * F.col("fdr"))).alias("mcc"),
    )


def fold_stats(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, least, greatest and sample deviation over folds."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"),
                 F.stddev_samp(v).alias(f"{v}_std")]
    return df.groupBy(*by).agg(*aggs)


def t_column(count: Column, level: float = 0.95) -> Column:
    """Student t quantile of a two-sided interval for `count` values, on the few aggregated rows; null below two."""
    q = (1 + level) / 2

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {k: t_quantile(q, k - 1) for k in n[n >= 2].unique()}
        return n.map(known).astype("float64")

    return quantile(count)


def confidence(df: DataFrame, by: Sequence[str], values: Sequence[str], level: float = 0.95) -> DataFrame:
    """Mean and half-width of its confidence interval over rounds or folds; NaN and null are left out."""
    aggs = []
    for v in values:
        c = F.when(~F.isnan(v), F.col(v).cast("double"))
        aggs += [F.avg(c).alias(f"{v}_mean"), F.count(c).alias(f"{v}_n"), F.stddev_samp(c).alias(f"{v}_std")]
    stats = df.groupBy(*by).agg(*aggs)
    half = {v: t_column(F.col(f"{v}_n"), level) * F.col(f"{v}_std") / F.sqrt(f"{v}_n") for v in values}
    return stats.select(*by, *[c for v in values for c in (F.col(f"{v}_mean"), half[v].alias(f"{v}_conf"))])
