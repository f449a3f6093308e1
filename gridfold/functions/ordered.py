"""Aggregates and choices whose ties are settled by rule: first row, mode, top k, tertiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order; give an order without ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", rank).filter("_first = 1").drop("_first")


def smallest_mode(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per key; of tied values the smallest. Nulls don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(name)
    return counts.groupBy(*keys).agg(best)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """At most k rows per key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def tertile(by: Column, tie: Column, *partition: Column) -> Column:
    """1 to 3 by rank with ties in the tie's order; thirds cut at n/3 and 2n/3 of ranks from the first, as quantile cuts do."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(by, tie))
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    edge = lambda q: 1 + (n - 1) * q / 3.0
    return F.when(rank <= edge(1), 1).when(rank <= edge(2), 2).otherwise(3)
