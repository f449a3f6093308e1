"""Point-in-time joins: only what was known strictly before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(decisions: DataFrame, vintages: DataFrame, key: list[str], at: str, vintage: str, values: list[str]) -> DataFrame:
    """Each decision with the values of the latest vintage of its key that is strictly earlier; decisions without one are dropped.

    Both sides are laid on one time line per key and values carried forward, so a key's rows are shuffled once and no pairs
    are made. A vintage of the decision's own time doesn't count.
    """
    value = F.struct(F.col(vintage).alias("vintage"), *values)
    right = vintages.select(*key, F.col(vintage).alias("_t"), F.lit(1).alias("_side"), value.alias("_v"))
    left = decisions.select(*key, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct(*[c for c in decisions.columns if c not in key]).alias("_row"))
    line = left.unionByName(right, allowMissingColumns=True)
    window = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    found = line.withColumn("_was", F.last("_v", ignorenulls=True).over(window)).filter("_side = 0 AND _was IS NOT NULL")
    return found.select(*key, "_row.*", F.col("_was.vintage").alias(f"{vintage}_used"), *[F.col(f"_was.{v}").alias(v) for v in values])


def strictly_prior(rows: DataFrame, group: list[str], at: str, measures: dict[str, Column]) -> DataFrame:
    """Adds aggregates over the rows of the same group with a strictly smaller time; rows of equal time don't see each other."""
    window = Window.partitionBy(*group).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: agg.over(window) for name, agg in measures.items()})


def lagged(left: DataFrame, right: DataFrame, key: list[str], year: str, columns: list[str], by: int = 1) -> DataFrame:
    """Left join of the values of `by` years before."""
    past = right.select(*key, (F.col(year) + by).alias(year), *[F.col(c).alias(f"{c}_lag{by}") for c in columns])
    return left.join(past, [*key, year], "left")
