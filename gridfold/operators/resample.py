"""Splits, re-splits and searches around the choice model: who trains, who tests, which columns help, and what leaks."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.operators import choice


def split(df: DataFrame, unit: str, shares: dict[str, float], seed: int = 0, u: Column | None = None) -> DataFrame:
    """Adds split: whole units go to one part, by a seeded hash of the unit (or u, a uniform number that depends on the unit alone); shares add up to one.

    The hash is the same in every partitioning and needs no list of units on the driver, so shares hold in expectation.
    """
    u = u if u is not None else (F.shiftrightunsigned(F.xxhash64(F.col(unit), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    names, edge, out = list(shares), 0.0, F.lit(list(shares)[-1])
    edges = np.cumsum([shares[n] for n in names])
    if abs(edges[-1] - 1) > 1e-9:
        raise ValueError("shares must add up to one")
    for name, edge in reversed(list(zip(names[:-1], edges[:-1], strict=True))):
        out = F.when(u < float(edge), name).otherwise(out)
    return df.withColumn("split", out)


def split_by_time(df: DataFrame, time: str, cutoff) -> DataFrame:
    """Adds split: train up to the cutoff, test after it; rows without a time are in neither (null)."""
    return df.withColumn("split", F.when(F.col(time) <= cutoff, "train").when(F.col(time) > cutoff, "test"))


def split_report(df: DataFrame, unit: str, event: str) -> DataFrame:
    """Per part its rows, units and events, and whether it has none: then its AUC is undefined and a conformal quantile one-sided."""
    happened = F.coalesce(F.col(event).cast("boolean"), F.lit(False))
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(unit).alias("units"), F.count_if(happened).alias("events"), (~F.bool_or(happened)).alias("eventless"))


def split_exact(df: DataFrame, unit: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """As split, with exact counts: units in a seeded order, cut at their shares. The order is one small table of units."""
    units = df.select(unit).distinct()
    n = units.count()
    order = units.withColumn("_k", F.row_number().over(Window.orderBy(F.xxhash64(unit, F.lit(seed)), unit)))
    out, edge = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())):
        edge -= share
        out = F.when(F.col("_k") > round((edge + share) * n), out).otherwise(F.lit(name))
    return df.join(order.withColumn("split", out).drop("_k"), unit)


def split_choices(choices: choice.Choices, shares: dict[str, float], seed: int = 0) -> dict[str, choice.Choices]:
    """The parts of the decisions, by name; all alternatives of a decision go with it."""
    part = lambda name: choices.decided(lambda rows: split(rows, choices.decision, shares, seed).filter(F.col("split") == name).drop("split"))
    return {name: part(name) for name in shares}


def resplits(choices: choice.Choices, arms: dict[str, list[str]], repeats: int = 5, train: float = 0.6) -> DataFrame:
    """Every arm fitted and scored on the same seeded splits: repeat, arm, brier, mean_p, top-k rates (spreads of these are not standard errors)."""
    out = []
    for r in range(repeats):
        parts = split_choices(choices, {"train": train, "test": 1 - train}, seed=r)
        for arm, columns in arms.items():
            f = choice.fit_decisions(parts["train"].per_decision(columns), columns, starts=(0.0,))
            row = choice.scored(parts["test"], columns, f.beta.tolist()).evaluate().first()
            out.append((r, arm, row.brier, row.mean_p, row.top1, row.top5, row.top10))
    return choices.rows.sparkSession.createDataFrame(out, "repeat int, arm string, brier double, mean_p double, top1 double, top5 double, top10 double")


def forward_selection(choices: choice.Choices, base: list[str], candidates: list[str], seed: int = 0) -> list[tuple[str, float]]:
    """Adds the column that most improves the log likelihood of held-out decisions, as long as one does; what was added, in order."""
    parts = split_choices(choices, {"train": 0.7, "test": 0.3}, seed)

    def held_out(columns: list[str]) -> float:
        f = choice.fit_decisions(parts["train"].per_decision(columns), columns, starts=(0.0,))
        return choice.scored(parts["test"], columns, f.beta.tolist()).choices().agg(F.avg(F.log("p"))).first()[0]

    have, added, best = list(base), [], held_out(base)
    while rest := [c for c in candidates if c not in have]:
        scores = {c: held_out([*have, c]) for c in rest}
        top = max(scores, key=lambda c: (scores[c], c))
        if scores[top] <= best:
            break
        best = scores[top]
        have.append(top)
        added.append((top, best))
    return added


def bootstrap_auc(rows: DataFrame, score: str, label: str, cluster: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """AUC per replicate, clusters drawn with replacement by Poisson(1) weights that depend on replicate and cluster alone."""
    u = lambda: (F.shiftrightunsigned(F.xxhash64("_rep", cluster, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    # distribution function of Poisson(1) at 0, 1, 2, ...
    edges = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(8)])
    weight = sum((F.when(u() > float(e), 1).otherwise(0) for e in edges), F.lit(0))
    by = rows.groupBy(cluster, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    reps = by.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight).filter("w > 0")
    tied = reps.groupBy("_rep", "s").agg(F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * F.col("n")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    g = ranked.groupBy(F.col("_rep").alias("replicate")).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return g.select("replicate", F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("auc"))


def merge_zones(alternatives: DataFrame, decision: str, alt: str, chosen: str, columns: list[str]) -> DataFrame:
    """Alternatives of a decision merged in pairs by their order: attractions add up, a pair is chosen if either was. Sums of utilities stay."""
    pair = F.floor((F.row_number().over(Window.partitionBy(decision).orderBy(alt)) - 1) / 2)
    return alternatives.withColumn(alt, pair).groupBy(decision, alt).agg(F.bool_or(chosen).alias(chosen), *[F.sum(c).alias(c) for c in columns])


def merge_shared_zones(choices: choice.Shared, columns: list[str]) -> choice.Shared:
    """The same where decisions share their alternatives: a market's are merged once."""
    market, alt = choices.market, choices.alternative
    pair = F.floor((F.row_number().over(Window.partitionBy(market).orderBy(alt)) - 1) / 2)
    paired = choices.rows.withColumn("_pair", pair)
    rows = paired.groupBy(market, F.col("_pair").alias(alt)).agg(*[F.sum(c).alias(c) for c in columns])
    decisions = choices.decisions.join(paired.select(market, alt, "_pair"), [market, alt]).withColumn(alt, F.col("_pair")).drop("_pair")
    return replace(choices, decisions=decisions, rows=rows)


def ablation(choices: choice.Choices, base: list[str], extra: str, repeats: int = 3) -> DataFrame:
    """With and without a covariate on the same splits: what it is worth, and what would be lost if it leaked."""
    both = resplits(choices, {"without": base, "with": [*base, extra]}, repeats)
    wide = both.groupBy("repeat").pivot("arm", ["with", "without"]).agg(F.first("mean_p"))
    return wide.select("repeat", F.col("with").alias("with_covariate"), F.col("without").alias("without_covariate"), (F.col("with") - F.col("without")).alias("worth"))


def boosted_benchmark(choices: choice.Choices, columns: list[str], seed: int = 0) -> DataFrame:
    """Gradient-boosted trees per alternative, then a softmax of their margins per decision at the temperature that fits best: a pointwise stand-in for a ranking loss.

    Where decisions share their alternatives, an alternative is one row per label with its number of decisions as weight.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=columns, outputCol="_x")
    parts = split_choices(choices, {"train": 0.6, "test": 0.4}, seed)
    model = GBTClassifier(featuresCol="_x", labelCol="y", weightCol="w", maxIter=10, maxDepth=3, seed=seed).fit(vectors.transform(parts["train"].examples(columns)))
    top = Window.partitionBy(choices.group)

    def margins(part: choice.Choices) -> choice.Choices:
        rows = model.transform(vectors.transform(part.rows)).withColumn("_m", vector_to_array("rawPrediction")[1])
        return replace(part, rows=rows.select(*part.rows.columns, "_m").cache())

    def at(part: choice.Choices, t: float) -> choice.Choices:
        e = part.rows.withColumn("_e", F.exp((F.col("_m") - F.max("_m").over(top)) / t))
        return replace(part, rows=e.withColumn("p", F.col("_e") / F.sum("_e").over(top)).drop("_e"))

    train = margins(parts["train"])
    loss = {t: at(train, t).choices().agg(F.avg(-F.log("p"))).first()[0] for t in (0.1, 0.3, 1.0, 3.0, 10.0)}
    best = min(loss, key=loss.get)
    return at(margins(parts["test"]), best).evaluate().withColumn("temperature", F.lit(best))


def stop_rule(draws: list[float], q: float, tolerance: float) -> bool:
    """Whether enough replicates were drawn: the percentile's Monte Carlo error is below the tolerance."""
    return len(draws) >= 50 and choice.percentile_mcse(np.array(draws), q) < tolerance


