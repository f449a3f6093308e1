"""Record linkage: blocking, three-way comparison, groups with conflict repair, and dates adjudicated by source.

Records have rid, street, city, state, zip, code. A group of records holds one building.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.text import address, jaro_winkler
from gridfold.operators.components import components
from gridfold.operators.storage import materialise, shared_dir

#: Street similarity from which streets count as the same, and from which a person decides.
CLOSE, WEAK = 0.92, 0.78
#: Records of a block above which pairs are not made.
LARGEST_BLOCK = 200


def link_records(rows: DataFrame) -> DataFrame:
    """Adds the parsed address (addr) and tidied fields."""
    tidy = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    parsed = rows.withColumn("addr", address(F.coalesce("street", F.lit(""))))
    return parsed.select("rid", tidy("state").alias("state"), tidy("city").alias("city"), F.substring(F.trim(F.coalesce("zip", F.lit(""))), 1, 5).alias("zip"), F.when(tidy("code") != "", tidy("code")).otherwise(F.col("addr.code")).alias("code"), "addr", *[c for c in rows.columns if c not in ("rid", "street", "city", "state", "zip", "code")])


def blocking_keys() -> Column:
    """State and house number; state and the street's first letters; building code."""
    key = lambda ok, *parts: F.when(ok != "", F.concat_ws("|", *parts))
    return F.array_compact(F.array(
        key(F.col("addr.number"), F.lit("N"), "state", "addr.number"),
        key(F.col("addr.core"), F.lit("S"), "state", F.substring("addr.core", 1, 5)),
        key(F.col("code"), F.lit("C"), "code"),
    ))


def candidate_pairs(records: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """Pairs a < b that share a block; a block above the largest size makes none (its keys are in skipped_blocks)."""
    keyed = records.select("rid", F.explode(blocking_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n").between(2, largest))
    small = keyed.join(sizes.select("key"), "key")
    other = small.select(F.col("rid").alias("b"), "key")
    return small.withColumnRenamed("rid", "a").join(other, "key").filter("a < b").select("a", "b").distinct()


def large_block_pairs(records: DataFrame, largest: int = LARGEST_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of the blocks above the largest size, and the finer blocks that are still too large (key, n): none of theirs are made.

    Every match of compare() stays connected. Records alike in all that is compared hang on the one with the smallest rid.
    In a code's block, where equal codes decide, each state's records hang on its smallest rid, and that of each state on that
    of the records without a state. Elsewhere a match needs the same house number and the same ZIP or city: these are the
    finer blocks, and only one record of each kind is in them.
    """
    alike = ["state", "city", "zip", "code", "addr"]
    keyed = records.select("rid", *alike, F.explode(blocking_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > largest).select("key")
    big = keyed.join(sizes, "key", "left_semi")
    kinds = big.groupBy("key", *alike).agg(F.min("rid").alias("least"))
    same = lambda c: F.col(f"x.{c}") == F.col(f"y.{c}")
    twins = big.alias("x").join(kinds.alias("y"), (same("key") & same("state") & same("city") & same("zip") & same("code") & same("addr"))).select(F.col("least").alias("a"), F.col("rid").alias("b"))
    coded = kinds.filter(F.col("key").startswith("C|")).groupBy("key", "state").agg(F.min("least").alias("first"))
    by_state = kinds.join(coded, ["key", "state"]).select(F.col("first").alias("a"), F.col("least").alias("b"))
    stateless = coded.filter("state = ''").select("key", F.col("first").alias("none"))
    over_states = coded.filter("state <> ''").join(stateless, "key").select(F.least("first", "none").alias("a"), F.greatest("first", "none").alias("b"))
    finer = F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat_ws("|", "key", "addr.number", F.lit(c), c)) for c in ("zip", "city")]))
    split = kinds.filter(~F.col("key").startswith("C|")).select("least", F.explode(finer).alias("key"))
    counts = split.groupBy("key").agg(F.count("*").alias("n"))
    small = split.join(counts.filter(F.col("n").between(2, largest)).select("key"), "key", "left_semi")
    others = small.withColumnRenamed("least", "a").join(small.withColumnRenamed("least", "b"), "key").select("a", "b")
    pairs = twins.unionByName(by_state).unionByName(over_states).unionByName(others).filter("a < b").distinct()
    return pairs, counts.filter(F.col("n") > largest)


def skipped_blocks(records: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    keyed = records.select("rid", F.explode(blocking_keys()).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > largest)


def _slot(a: Column, b: Column) -> Column:
    return F.when(a == b, "agree").when((a == "") | (b == ""), "missing").otherwise("conflict")


def compare(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Verdicts on pairs (a, b): call (match, review, nonmatch), why, weak, score. The first rule that applies decides."""
    side = lambda c: records.select(F.col("rid").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("state", "city", "zip", "code", "addr")])
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.withColumn("sim", F.when(F.col("a_addr.core") == F.col("b_addr.core"), 1.0).otherwise(jaro_winkler("a_addr.core", "b_addr.core")))
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    both = lambda x: (a(x) != "") & (b(x) != "")
    same = lambda x: both(x) & (a(x) == b(x))
    pre, post, suffix = (_slot(a(f"addr.{k}"), b(f"addr.{k}")) for k in ("predir", "postdir", "suffix"))
    place = same("zip") | same("city")
    weak = (F.col("sim") < 1) | (pre == "missing") | (post == "missing") | (suffix == "missing")
    no, maybe = F.lit(0.0), F.col("sim")
    rules = [
        (both("state") & (a("state") != b("state")), "nonmatch", "state", False, no),
        (same("code"), "match", "code", False, F.lit(1.0)),
        (both("code"), "nonmatch", "codes differ", False, no),
        (~both("addr.street") & same("zip") & (a("city") == b("city")), "review", "no street", False, no),
        (~both("addr.street"), "nonmatch", "no street", False, no),
        (a("addr.number") != b("addr.number"), "nonmatch", "house number", False, no),
        ((pre == "conflict") | (post == "conflict"), "nonmatch", "direction", False, no),
        (maybe < WEAK, "nonmatch", "street", False, maybe),
        (suffix == "conflict", "review", "street type", True, maybe),
        (maybe < CLOSE, "review", "street", True, maybe),
        (~place, "review", "no place agrees", True, maybe),
    ]
    verdict = F.struct(F.lit("match").alias("call"), F.lit("street and place").alias("why"), weak.alias("weak"), maybe.alias("score"))
    for when, call, why, is_weak, score in reversed(rules):
        verdict = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(call).alias("call"), F.lit(why).alias("why"), F.lit(is_weak).alias("weak"), score.alias("score"))).otherwise(verdict)
    return p.select("a", "b", verdict.alias("v")).select("a", "b", "v.*")


def groups(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rid, group (its smallest rid), ambiguous. A group of three or more with a rejected pair inside is rebuilt from strong matches only."""
    folder = shared_dir(records.sparkSession, "linkage")
    verdicts = materialise(verdicts.select("a", "b", "call", "weak"), f"{folder}/verdicts")
    matches = verdicts.filter("call = 'match'").select("a", "b", "weak")
    first = materialise(components(matches.select("a", "b"), f"{folder}/all"), f"{folder}/first") if not matches.isEmpty() else None
    own = records.select("rid")
    if first is None:
        return own.select("rid", F.col("rid").alias("group"), F.lit(False).alias("ambiguous"))
    of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    rejected = verdicts.filter("call = 'nonmatch'").join(of("a"), "a").join(of("b"), "b").filter("of_a = of_b").select(F.col("of_a").alias("component"))
    sizes = first.groupBy("component").agg(F.count("*").alias("n")).filter("n >= 3").select("component")
    torn = materialise(rejected.join(sizes, "component", "left_semi").distinct(), f"{folder}/torn")
    if torn.isEmpty():
        out = first.select("node", F.col("component").alias("group"), F.lit(False).alias("ambiguous"))
    else:
        loose = first.join(torn, "component", "left_semi").select("node")
        strong = matches.filter("NOT weak").join(loose.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")
        rebuilt = components(strong, f"{folder}/strong")
        redone = loose.join(rebuilt, "node", "left").select("node", F.coalesce("component", "node").alias("group"), F.col("component").isNull().alias("ambiguous"))
        kept = first.join(torn, "component", "left_anti").select("node", F.col("component").alias("group"), F.lit(False).alias("ambiguous"))
        out = kept.unionByName(redone)
    return own.join(out, own["rid"] == out["node"], "left").select("rid", F.coalesce("group", "rid").alias("group"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def adjudicate(rows: DataFrame, group: str, date: str, rank: str) -> DataFrame:
    """A date per group: where its dates differ, that of the best-ranked source if one source alone is best, else none (unresolved)."""
    best = rows.filter(F.col(date).isNotNull()).withColumn("_best", F.struct(rank, date))
    by = best.groupBy(group).agg(F.min(date).alias("earliest"), F.max(date).alias("latest"), F.min(rank).alias("_rank"), F.min_by(date, F.col(rank)).alias("_date"))
    ties = best.join(by.select(group, "_rank"), group).filter(F.col(rank) == F.col("_rank")).groupBy(group).agg(F.count_distinct(date).alias("_n"))
    out = by.join(ties, group).withColumn("contradicted", F.col("earliest") < F.col("latest"))
    value = F.when(~F.col("contradicted"), F.col("earliest")).when(F.col("_n") == 1, F.col("_date"))
    return out.select(group, "earliest", "latest", "contradicted", value.alias("resolved"), value.isNull().alias("unresolved"))


def require_resolved(adjudicated: DataFrame) -> DataFrame:
    """Raises while a group's dates contradict each other."""
    open_ = adjudicated.filter("unresolved").limit(3).collect()
    if open_:
        raise ValueError(f"unresolved dates: {[r.asDict() for r in open_]}")
    return adjudicated


def blocking_audit(records: DataFrame) -> DataFrame:
    """Matches among all pairs of a state, and how many of them blocking generates: one row. Meant for bounded samples of records."""
    other = records.select(F.col("rid").alias("b"), "state")
    every = records.select(F.col("rid").alias("a"), "state").join(other, "state").filter("a < b").select("a", "b")
    found = compare(every, records).filter("call = 'match'").select("a", "b")
    kept = found.join(candidate_pairs(records), ["a", "b"], "left_semi")
    return found.agg(F.count("*").alias("matches")).crossJoin(kept.agg(F.count("*").alias("generated")))


#: Row checks of a proposed change, in order; the first that fails rejects it.
def gate(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds rejected_by: the name of the first check that a row fails, null if it passes all."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return rows.withColumn("rejected_by", out)
