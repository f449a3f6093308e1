"""Contracts and flags: grain, coverage, sentinels, edits, flag gate, schema and vocabulary checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings that mark a column as a statement about how a value came to be.
FLAG_SUFFIXES = ("_imputed", "_topcoded", "_bottomcoded", "_suppressed", "_observed", "_available")


class ContractError(ValueError):
    """A table breaks what it promises."""


def grain_violations(df: DataFrame, key: list[str], worst: int = 3) -> DataFrame:
    """The keys with most rows, of those with more than one."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1").orderBy(F.desc("rows"), *key).limit(worst)


def check_grain(df: DataFrame, key: list[str]) -> DataFrame:
    """Raises unless the key is unique."""
    found = grain_violations(df, key).collect()
    if found:
        raise ContractError(f"{key} is not unique: {[r.asDict() for r in found]}")
    return df


def coverage(df: DataFrame) -> DataFrame:
    """Non-null values of every column, in one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    long = counts.unpivot("_rows", df.columns, "column", "non_null")
    return long.select("column", "non_null", (100.0 * F.col("non_null") / F.nullif("_rows", F.lit(0))).alias("pct"))


@dataclass(frozen=True)
class Sentinel:
    """A code that stands for something else than its value: TOP (at least), BOTTOM (at most) or ABSENT (null)."""

    field: str
    kind: str
    flag: str
    code: float | None = None

    def detect(self) -> Column:
        value = F.col(self.field)
        found = {"TOP": lambda: value >= self.code, "BOTTOM": lambda: value <= self.code, "ABSENT": value.isNull}[self.kind]()
        return F.coalesce(found, F.lit(False))


def flag_sentinels(df: DataFrame, sentinels: Iterable[Sentinel]) -> DataFrame:
    """A flag column, never null, per sentinel whose field the table has."""
    return df.withColumns({s.flag: s.detect() for s in sentinels if s.field in df.columns})


def flag_gate(sources: Mapping[str, DataFrame], panel: DataFrame, registry: Iterable[Sentinel] = ()) -> None:
    """Raises where a flag that a source or the registry computes does not reach the panel."""
    flags = {c for df in sources.values() for c in df.columns if c.endswith(FLAG_SUFFIXES)} | {s.flag for s in registry}
    if lost := sorted(flags - set(panel.columns)):
        raise ContractError(f"flags that stop before the panel: {lost}")


@dataclass(frozen=True)
class Edit:
    """A condition that every row must meet; REPORT flags the others, EXCLUDE drops them. Unknown counts as met."""

    name: str
    holds: Column
    action: str = "REPORT"


def apply_edits(df: DataFrame, edits: Iterable[Edit]) -> DataFrame:
    for e in edits:
        failed = ~F.coalesce(e.holds, F.lit(True))
        df = df.withColumn(f"fails_{e.name}", failed) if e.action == "REPORT" else df.filter(~failed)
    return df


def check_schema(df: DataFrame, required: Iterable[str], vocabularies: Mapping[str, Iterable[str]] | None = None, rules: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Raises on missing columns; else the number of rows against each vocabulary and rule, in one pass."""
    if missing := sorted(set(required) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")
    checks = {f"{c} outside its vocabulary": ~F.col(c).isin(list(words)) for c, words in (vocabularies or {}).items()} | {k: ~v for k, v in (rules or {}).items()}
    if not checks:
        return {}
    row = df.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in checks.items()]).first()
    return {k: row[k] for k in checks}


def check_report(df: DataFrame, required: Iterable[str], errors: Mapping[str, Column], warnings: Mapping[str, Column] | None = None, stats: Mapping[str, Column] | None = None) -> DataFrame:
    """level (error, warning, stat), name, n (rows for which the condition holds; unknown counts as not), ok (errors only: n is 0).

    One pass over the table. A missing column is an error row of its own, and then nothing else is looked at.
    """
    spark = df.sparkSession
    if missing := sorted(set(required) - set(df.columns)):
        return spark.createDataFrame([("error", f"missing column {c}", 1, False) for c in missing], "level string, name string, n long, ok boolean")
    checks = [(level, name, c) for level, own in (("error", errors), ("warning", warnings or {}), ("stat", stats or {})) for name, c in own.items()]
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, (_, _, c) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"), F.col(f"c{k}").alias("n")) for k, (level, name, _) in enumerate(checks)])
    out = counted.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("ok", F.when(F.col("level") == "error", F.col("n") == 0))
