"""Spreading a total over rows in proportion to a score, at most one each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allocate(rows: DataFrame, key: str, score: str, total: float) -> DataFrame:
    """Adds p. Rows whose share would pass one are held at one and the rest is spread over the others, until none passes.

    The rows held are those of the largest scores; with k of them the unit is (total - k) / (sum of the other scores). Both
    come from running sums per distinct score, so the answer is one pass and not a loop.
    """
    from pyspark.sql import Window

    good = rows.withColumn("_s", F.when((F.col(score) > 0) & ~F.isnan(F.col(score).cast("double")), F.col(score).cast("double")).otherwise(0.0))
    by = good.filter("_s > 0").groupBy("_s").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    steps = by.withColumns({"held": F.coalesce(F.sum("n").over(above), F.lit(0)), "rest": F.sum(F.col("_s") * F.col("n")).over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))})
    unit = F.greatest(F.lit(0.0), total - F.col("held")) / F.col("rest")
    # the first score, from the largest, that fits below one at its unit
    fits = steps.withColumn("unit", unit).filter(F.col("_s") * F.col("unit") <= 1).agg(F.max_by("unit", "_s").alias("unit"))
    p = F.when(F.col("unit").isNull(), F.when(F.col("_s") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.col("_s") * F.col("unit")))
    return good.crossJoin(F.broadcast(fits)).withColumn("p", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))).select(key, score, "p")
