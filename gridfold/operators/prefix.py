"""Ranks and running sums over all rows by prefix sums: rows are dealt by ranges of the order, and a range begins where those before it end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.operators.storage import materialise, n_shuffle, shared_dir


def running(df: DataFrame, order: list, sums: list[str], *, rank: str = "rank") -> DataFrame:
    """Adds the rank of each row in an order without ties, and running_<column> for each sum (nulls count as 0).

    The ranges are written once, so that each row's stays as it is; a window orders one range, and what goes to every task is
    one row per range.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(n_shuffle(spark), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, f"{shared_dir(spark, 'ranges')}/rows")
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(value(c)).alias(f"_s_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_n", *[f"_s_{c}" for c in sums])])
    within = Window.partitionBy("_range").orderBy(*order)
    out = dealt.join(F.broadcast(starts), "_range").withColumn(rank, F.col("_before_n") + F.row_number().over(within))
    for c in sums:
        out = out.withColumn(f"running_{c}", F.col(f"_before_s_{c}") + F.sum(value(c)).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*df.columns, rank, *[f"running_{c}" for c in sums])
