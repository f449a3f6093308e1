"""Facility records: typing, one national shape, merging a new source into a base table, choosing a batch.

Raw rows have text fields only. Verdicts on pairs come from linkage.compare or from any rule with the same columns
(a: the new row, b: the base row or another new one, call: match, review or nonmatch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.columns import quarter_index, zpad
from gridfold.operators.quality import ContractError

#: The quarter index of a facility that is still open.
NEVER = 2_147_483_647


def typed(raw: DataFrame, *, numbers: list[str], status: str = "status", default: str = "open") -> DataFrame:
    """ZIP padded to five, numbers where they are numbers, a blank status as the default, opening and closing quarter as indexes (open: NEVER).

    Rows whose opening year is no number have a null opening: see refuse().
    """
    year = lambda c: F.col(c).try_cast("int")
    tidy = F.nullif(F.lower(F.trim(F.col(status))), F.lit(""))
    out = raw.withColumns({c: F.regexp_replace(F.col(c), ",", "").try_cast("double") for c in numbers})
    return out.withColumns({
        "zip": zpad(F.trim(F.col("zip")), 5), status: F.coalesce(tidy, F.lit(default)),
        "open_q": quarter_index(year("open_year"), F.coalesce(year("open_quarter"), F.lit(1))),
        "close_q": F.coalesce(quarter_index(year("close_year"), F.coalesce(year("close_quarter"), F.lit(1))), F.lit(NEVER)),
    })


def refuse(rows: DataFrame, unresolved: Column, what: str) -> DataFrame:
    """The rows; raises where any of them is unresolved."""
    if n := rows.filter(unresolved).count():
        raise ContractError(f"{n} rows are unresolved: {what}")
    return rows


def national(rows: DataFrame, kinds: dict[str, str], as_of: int) -> DataFrame:
    """One shape for all sources: category by kind, whether it operates in a quarter, confidence by what is known, and whether it is vouched for."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("kind")), F.lit("other"))
    known = F.col("sqft").isNotNull().cast("int") + F.col("open_q").isNotNull().cast("int") + (F.col("close_q") != NEVER).cast("int")
    status = F.when(F.col("open_q").isNull(), "unknown").when(F.col("open_q") > as_of, "planned").when(F.col("close_q") <= as_of, "closed").otherwise("operating")
    return rows.withColumns({"category": kind, "operation": status, "confidence": F.when(known >= 2, "high").when(known == 1, "medium").otherwise("low"), "vouched": (known >= 2) & (kind != "other")})


def merge_source(new: DataFrame, among: DataFrame, across: DataFrame, key: str) -> DataFrame:
    """What becomes of each new row: key, action, into.

    duplicate: it matches a smaller new row (into); merged: it matches a base row (into, the smallest); held: a person must
    look at a pair of it; appended: none of these. among has the pairs of new rows (a > b), across those with the base.
    """
    best = lambda pairs, call, name: pairs.filter(F.col("call") == call).groupBy("a").agg(F.min("b").alias(name)).withColumnRenamed("a", key)
    out = new.select(key).join(best(among, "match", "_twin"), key, "left").join(best(across, "match", "_base"), key, "left").join(best(across.unionByName(among), "review", "_review"), key, "left")
    action = F.when(F.col("_twin").isNotNull(), "duplicate").when(F.col("_base").isNotNull(), "merged").when(F.col("_review").isNotNull(), "held").otherwise("appended")
    return out.select(key, action.alias("action"), F.coalesce("_twin", "_base").alias("into"))


def merge_report(actions: DataFrame) -> DataFrame:
    """How many rows each action has, and their share."""
    by = actions.groupBy("action").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(actions.agg(F.count("*").alias("all")))).select("action", "n", (F.col("n") / F.col("all")).alias("share"))


def batch_candidates(actions: DataFrame, key: str) -> DataFrame:
    """The rows that a batch may append; raises while any row is held."""
    return refuse(actions, F.col("action") == "held", "held for review").filter(F.col("action") == "appended").select(key)


def unambiguous_prefix(names: DataFrame, name: str, regions: DataFrame, region: str) -> DataFrame:
    """Each distinct name with the one region that begins with it; names that begin none or several get null. Regions are broadcast: a list of some thousands."""
    each = names.select(name).distinct()
    few = F.broadcast(regions.select(region).distinct())
    found = each.join(few, F.col(region).startswith(F.col(name))).groupBy(name).agg(F.count("*").alias("_n"), F.min(region).alias(region)).filter("_n = 1").drop("_n")
    return each.join(found, name, "left")


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns in their order, some with new values; raises on a column that isn't there."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"no such columns: {missing}")
    return df.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in df.columns])


def vintage_gate(rows: DataFrame, vintage: str, measure: str, floor: float) -> DataFrame:
    """Per vintage its rows, coverage of the measure, and whether it may be used."""
    by = rows.groupBy(vintage).agg(F.count("*").alias("n"), F.avg(F.col(measure).isNotNull().cast("double")).alias("coverage"))
    return by.withColumn("usable", F.col("coverage") >= floor)
