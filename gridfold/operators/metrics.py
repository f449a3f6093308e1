"""Scores of probabilities and rankings: AUC, Brier, calibration, conformal quantiles, strata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions.columns import average_rank


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by tie-averaged ranks; null where a class is missing. One row: auc, positives, negatives.

    Ranks come from counts per distinct score and running totals over them, so no task sorts all rows by itself.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    total = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    value = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q")))
    return total.select(value.alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def auc_by_rank(df: DataFrame, score: str, label: str, *groups: str) -> DataFrame:
    """AUC per group, by average ranks within it."""
    rank = average_rank(F.col(score), *[F.col(g) for g in groups])
    y = F.col(label).cast("long")
    sums = df.withColumn("_r", rank).groupBy(*groups).agg(F.sum(F.when(y == 1, F.col("_r"))).alias("r"), F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    return sums.select(*groups, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("auc"))


def brier(p, y) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y).cast("double"), F.lit(2.0)))


def brier_skill(df: DataFrame, p: str, y: str) -> DataFrame:
    """Brier against always predicting the base rate; null where that is perfect."""
    row = df.agg(brier(p, y).alias("brier"), F.avg(F.col(y).cast("double")).alias("rate"))
    base = F.col("rate") * (1 - F.col("rate"))
    return row.select("brier", "rate", F.when(base > 0, 1 - F.col("brier") / base).alias("skill"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """Observed against predicted per bin; quantile edges hold equal counts, repeated edges merge."""
    if strategy == "quantile":
        edges = sorted(set(df.agg(F.percentile(p, [k / bins for k in range(bins + 1)])).first()[0]))
    elif strategy == "uniform":
        edges = [k / bins for k in range(bins + 1)]
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    inner = edges[1:-1]
    index = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("mean_observed"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("mean_observed"))) / F.sum("n")).alias("ece"))


def conformal_rank(n: int, alpha: float) -> int:
    """The order statistic that covers 1 - alpha of new scores; above n there is none."""
    return math.ceil((n + 1) * (1 - alpha))


def conformal_quantile(df: DataFrame, score: str, alpha: float) -> float:
    """The score of that rank; infinite where the sample is too small."""
    n = df.count()
    k = conformal_rank(n, alpha)
    if k > n:
        return math.inf
    # the k-th smallest is the least of the n - k + 1 largest
    return df.orderBy(F.desc(score)).limit(n - k + 1).agg(F.min(score)).first()[0]


def binary_sets(df: DataFrame, p: str, q: float, slack: float = 0.0) -> DataFrame:
    """Adds yes and no: whether the label is in the prediction set, its nonconformity (1 - its probability) being at most q."""
    return df.withColumns({"yes": 1 - F.col(p) <= q + slack, "no": F.col(p) <= q + slack})


def mcnemar_exact(only_a: int, only_b: int) -> float:
    """Two-sided exact p-value of discordant counts."""
    n, k = only_a + only_b, min(only_a, only_b)
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    return min(1.0, 2 * tail)
