"""Risk sets of discrete-time event data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.operators.quality import ContractError


def risk_set(rows: DataFrame, unit: str, t: str, event: str, first) -> DataFrame:
    """Person-periods after the first period and up to a unit's first event; units whose event is in the first period go."""
    at = F.min(F.when(F.col(event), F.col(t))).over(Window.partitionBy(unit))
    kept = rows.withColumn("_at", at).filter((F.col(t) > first) & (F.col("_at").isNull() | ((F.col(t) <= F.col("_at")) & (F.col("_at") > first))))
    return kept.drop("_at")


def check_risk_set(rows: DataFrame, unit: str, t: str, event: str) -> DataFrame:
    """Raises on a unit with two events, or with a period after its event."""
    by = rows.groupBy(unit).agg(F.count_if(event).alias("events"), F.max(F.when(F.col(event), F.col(t))).alias("at"), F.max(t).alias("last"))
    if not by.filter("events > 1 OR last > at").isEmpty():
        raise ContractError("a risk set holds one event per unit at most, and nothing after it")
    return rows
