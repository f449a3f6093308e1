"""Location choice: probabilities proportional to a weighted sum of attractions, fitted by maximum likelihood.

p(j) = beta . a_j / sum over the decision's alternatives, with beta = exp(theta) and the first attraction's beta fixed at 1.
Likelihood, gradient and Hessian are sums over decisions, computed in one aggregation per step; the driver sees k numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A coefficient below this share of the numeraire is at the boundary: it has no standard error.
BOUNDARY = 1e-6


def utility(columns: list[str], beta: list[float]) -> Column:
    total = F.lit(0.0)
    for c, b in zip(columns, beta, strict=True):
        total = total + F.lit(float(b)) * F.col(c)
    return total


def probabilities(alternatives: DataFrame, decision: str, columns: list[str], beta: list[float]) -> DataFrame:
    """Adds p; a decision's probabilities add up to one."""
    u = alternatives.withColumn("_u", utility(columns, beta))
    return u.withColumn("p", F.col("_u") / F.sum("_u").over(Window.partitionBy(decision))).drop("_u")


def ranked(choices: DataFrame, decision: str, alternative: str) -> DataFrame:
    """Adds rank (by p, ties by alternative), cumulative p and the number of alternatives."""
    order = Window.partitionBy(decision).orderBy(F.desc("p"), alternative)
    return choices.withColumns({"rank": F.row_number().over(order), "cumulative": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)), "alternatives": F.count("*").over(Window.partitionBy(decision))})


def evaluate(choices: DataFrame, decision: str, alternative: str, chosen: str, ks=(1, 5, 10)) -> DataFrame:
    """Brier (mean over alternatives), mean p of the choice, top-k rates, and the same for uniform odds. One row."""
    r = ranked(choices, decision, alternative)
    y = F.col(chosen).cast("double")
    n = F.col("alternatives")
    hits = [F.avg(F.when(F.col(chosen), (F.col("rank") <= k).cast("double"))).alias(f"top{k}") for k in ks]
    chance = [F.avg(F.when(F.col(chosen), F.least(F.lit(1.0), k / n))).alias(f"chance{k}") for k in ks]
    return r.agg(F.avg(F.pow(F.col("p") - y, F.lit(2.0))).alias("brier"), F.avg(F.pow(1 / n - y, F.lit(2.0))).alias("brier_uniform"), F.avg(F.when(F.col(chosen), F.col("p"))).alias("mean_p"), *hits, *chance)


@dataclass(frozen=True)
class Listed:
    """Decisions with their alternatives listed: a row per decision and alternative. rows may have p."""

    rows: DataFrame
    decision: str
    alternative: str
    chosen: str

    @property
    def group(self) -> str:
        """What p adds up to one within."""
        return self.decision

    def per_decision(self, columns: list[str], keep: list[str] = ()) -> DataFrame:
        return per_decision(self.rows, self.decision, self.chosen, columns, keep)

    def ranks(self) -> DataFrame:
        """The chosen rows with rank, cumulative and alternatives."""
        return ranked(self.rows, self.decision, self.alternative).filter(self.chosen)

    def choices(self) -> DataFrame:
        return self.rows.filter(self.chosen)

    def evaluate(self, ks=(1, 5, 10)) -> DataFrame:
        return evaluate(self.rows, self.decision, self.alternative, self.chosen, ks)

    def decided(self, keep) -> Listed:
        """Only the decisions that keep (a function of a table with their ids) leaves."""
        return replace(self, rows=keep(self.rows))

    def examples(self, columns: list[str]) -> DataFrame:
        """The columns, y (1 for the choice) and how many rows of them there are, w."""
        return self.rows.select(*columns, F.col(self.chosen).cast("double").alias("y"), F.lit(1.0).alias("w"))


@dataclass(frozen=True)
class Shared:
    """Decisions that share their alternatives: all decisions of a market choose among its rows, which are kept once.

    decisions: a row each, with its market and the alternative that it chose; rows: a row per market and alternative, which may
    have p. Probabilities, ranks and sums of a market hold for each of its decisions, so nothing has a row per decision and
    alternative: a market of n decisions and n alternatives costs n log n, not n * n. A decision whose choice is not among
    its market's rows has no p and no rank, and cannot be fitted.
    """

    decisions: DataFrame
    rows: DataFrame
    decision: str
    market: str
    alternative: str

    @property
    def group(self) -> str:
        return self.market

    def per_decision(self, columns: list[str], keep: list[str] = ()) -> DataFrame:
        sums = self.rows.groupBy(self.market).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{k}") for k, c in enumerate(columns)])
        picks = self.rows.select(self.market, self.alternative, *[F.col(c).alias(f"c_{k}") for k, c in enumerate(columns)])
        made = self.decisions.join(picks, [self.market, self.alternative], "left").join(sums, self.market, "left")
        return made.select(self.decision, *keep, "n", *[f"{x}_{k}" for x in "sc" for k in range(len(columns))])

    def ranks(self) -> DataFrame:
        return self.decisions.join(ranked(self.rows, self.market, self.alternative), [self.market, self.alternative])

    def choices(self) -> DataFrame:
        return self.decisions.join(self.rows, [self.market, self.alternative])

    def evaluate(self, ks=(1, 5, 10)) -> DataFrame:
        """As the function of that name: of a decision's squared errors all but its choice's are its market's sum of p * p."""
        whole = Window.partitionBy(self.market)
        r = ranked(self.rows, self.market, self.alternative).withColumns({"_squares": F.sum(F.col("p") * F.col("p")).over(whole), "_scored": F.count("p").over(whole)})
        made = self.decisions.join(r, [self.market, self.alternative])
        n, p = F.col("alternatives"), F.col("p")
        errors = F.coalesce("_squares", F.lit(0.0)) + F.coalesce(1 - 2 * p, F.lit(0.0))
        hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in ks]
        chance = [F.avg(F.least(F.lit(1.0), k / n)).alias(f"chance{k}") for k in ks]
        return made.agg(F.try_divide(F.sum(errors), F.sum("_scored")).alias("brier"), F.try_divide(F.sum(1 - 1 / n), F.sum(n)).alias("brier_uniform"), F.avg(p).alias("mean_p"), *hits, *chance)

    def decided(self, keep) -> Shared:
        return replace(self, decisions=keep(self.decisions))

    def examples(self, columns: list[str]) -> DataFrame:
        made = self.decisions.groupBy(self.market).agg(F.count("*").alias("_made"))
        picked = self.decisions.groupBy(self.market, self.alternative).agg(F.count("*").alias("_picked"))
        rows = self.rows.join(made, self.market).join(picked, [self.market, self.alternative], "left").withColumn("_picked", F.coalesce("_picked", F.lit(0)))
        of = lambda y, n: F.struct(F.lit(y).alias("y"), n.cast("double").alias("w"))
        both = F.array(of(1.0, F.col("_picked")), of(0.0, F.col("_made") - F.col("_picked")))
        return rows.withColumn("_e", F.explode(both)).select(*columns, "_e.y", "_e.w").filter("w > 0")


Choices = Listed | Shared


def scored(choices: Choices, columns: list[str], beta: list[float]) -> Choices:
    """With p on its rows."""
    return replace(choices, rows=probabilities(choices.rows, choices.group, columns, beta))


@dataclass(frozen=True)
class ChoiceFit:
    columns: tuple[str, ...]
    beta: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    at_boundary: np.ndarray
    hessian: np.ndarray
    covariance: np.ndarray | None

    @property
    def rho2(self) -> float:
        """McFadden's, against uniform odds."""
        return 1 - self.log_likelihood / self.null_log_likelihood


def per_decision(alternatives: DataFrame, decision: str, chosen: str, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """A row per decision: the sums of each attraction over alternatives and the chosen one's: all that the likelihood needs.

    Utilities are linear in beta, so sums of utilities follow from sums of attractions at any beta, and fitting touches the
    alternatives once.
    """
    return alternatives.groupBy(decision, *keep).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{k}") for k, c in enumerate(columns)], *[F.max(F.when(F.col(chosen), F.col(c))).alias(f"c_{k}") for k, c in enumerate(columns)])


def _sums(decisions: DataFrame, beta: np.ndarray, weight: Column | None = None, cluster: str | None = None):
    """Log likelihood, gradient and Hessian in theta (of the coefficients after the first), in one pass."""
    k = len(beta)
    s = sum((F.lit(float(b)) * F.col(f"s_{i}") for i, b in enumerate(beta)), F.lit(0.0))
    c = sum((F.lit(float(b)) * F.col(f"c_{i}") for i, b in enumerate(beta)), F.lit(0.0))
    w = F.lit(1.0) if weight is None else weight
    g = [F.lit(float(beta[i])) * (F.col(f"c_{i}") / F.col("_c") - F.col(f"s_{i}") / F.col("_s")) for i in range(1, k)]
    base = decisions.withColumns({"_s": s, "_c": c})
    out = [F.sum(w * F.log(F.col("_c") / F.col("_s")))]
    out += [F.sum(w * x) for x in g]
    for i in range(1, k):
        for j in range(1, i + 1):
            both = float(beta[i] * beta[j])
            h = F.lit(both) * (F.col(f"s_{i}") * F.col(f"s_{j}") / (F.col("_s") * F.col("_s")) - F.col(f"c_{i}") * F.col(f"c_{j}") / (F.col("_c") * F.col("_c")))
            out.append(F.sum(w * (h + g[i - 1] if i == j else h)))
    row = base.agg(*[x.alias(f"x{m}") for m, x in enumerate(out)]).first()
    row = [x if x is not None else 0.0 for x in row]
    hess = np.zeros((k - 1, k - 1))
    at = k
    for i in range(k - 1):
        for j in range(i + 1):
            hess[i, j] = hess[j, i] = row[at]
            at += 1
    return row[0], np.array(row[1:k]), hess


def _scores(decisions: DataFrame, beta: np.ndarray, cluster: str | None) -> np.ndarray:
    """Sum of outer products of scores, per decision or per cluster."""
    k = len(beta)
    s = sum((F.lit(float(b)) * F.col(f"s_{i}") for i, b in enumerate(beta)), F.lit(0.0))
    c = sum((F.lit(float(b)) * F.col(f"c_{i}") for i, b in enumerate(beta)), F.lit(0.0))
    rows = decisions.withColumns({"_s": s, "_c": c})
    g = {f"g_{i}": F.lit(float(beta[i])) * (F.col(f"c_{i}") / F.col("_c") - F.col(f"s_{i}") / F.col("_s")) for i in range(1, k)}
    rows = rows.withColumns(g)
    if cluster:
        rows = rows.groupBy(cluster).agg(*[F.sum(name).alias(name) for name in g])
    pairs = [(i, j) for i in range(1, k) for j in range(1, i + 1)]
    row = rows.agg(*[F.sum(F.col(f"g_{i}") * F.col(f"g_{j}")).alias(f"o_{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k - 1, k - 1))
    for (i, j), x in zip(pairs, row, strict=True):
        out[i - 1, j - 1] = out[j - 1, i - 1] = x
    return out


def fit(alternatives: DataFrame, decision: str, chosen: str, columns: list[str], *, cluster: str | None = None, starts=(0.0, -2.0, 2.0), steps: int = 60) -> ChoiceFit:
    """Maximum likelihood by Newton steps with line search in theta, from several starts; sandwich covariance inside the boundary."""
    return fit_decisions(per_decision(alternatives, decision, chosen, columns, [cluster] if cluster else []), columns, cluster=cluster, starts=starts, steps=steps)


def fit_decisions(decisions: DataFrame, columns: list[str], *, cluster: str | None = None, starts=(0.0, -2.0, 2.0), steps: int = 60) -> ChoiceFit:
    """The same from per_decision's rows."""
    decisions = decisions.cache()
    if not decisions.filter(" OR ".join(f"c_{i} IS NULL" for i in range(len(columns)))).isEmpty():
        raise ValueError("a decision has no chosen alternative, or a missing attraction")
    if not decisions.filter("s_0 <= 0 OR c_0 <= 0").isEmpty():
        raise ValueError("the first attraction must be positive")
    best = None
    for start in starts if len(columns) > 1 else (0.0,):
        theta = np.full(len(columns) - 1, float(start))
        value, grad, hess = _sums(decisions, np.exp(np.concatenate([[0.0], theta])))
        for _ in range(steps):
            if not len(theta) or np.abs(grad).max() < 1e-7:
                break
            try:
                eig = np.linalg.eigvalsh(-hess)
                move = np.linalg.solve(-hess + max(0.0, 1e-8 - eig.min()) * np.eye(len(theta)), grad)
            except np.linalg.LinAlgError:
                move = grad
            if move @ grad <= 0:
                move = grad
            move *= min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
            scale, moved = 1.0, False
            while scale > 1e-6:
                tried = np.maximum(theta + scale * move, -40.0)
                new = _sums(decisions, np.exp(np.concatenate([[0.0], tried])))
                if new[0] > value + 1e-12 * abs(value):
                    theta, (value, grad, hess), moved = tried, new, True
                    break
                scale /= 4
            if not moved:
                break
        if best is None or value > best[1]:
            best = theta, value, hess
    theta, value, hess = best
    beta = np.exp(np.concatenate([[0.0], theta]))
    null = decisions.agg(F.sum(-F.log(F.col("n").cast("double")))).first()[0]
    boundary = beta < BOUNDARY
    covariance = None
    if len(theta) and not boundary.any():
        bread = np.linalg.inv(-hess)
        covariance = bread @ _scores(decisions, beta, cluster) @ bread
    decisions.unpersist()
    return ChoiceFit(tuple(columns), beta, float(value), float(null), boundary, hess, covariance)


def bootstrap(alternatives: DataFrame, decision: str, chosen: str, columns: list[str], *, replicates: int = 200, cluster: str | None = None, seed: int = 0) -> DataFrame:
    """Replicate coefficients: replicate, coefficient, beta. Decisions (or clusters) are drawn with replacement.

    The per-decision sums (k numbers each) are collected to every replicate's task by a broadcast of checked size.
    """
    spark = alternatives.sparkSession
    keep = [cluster] if cluster else []
    rows = per_decision(alternatives, decision, chosen, columns, keep).toPandas()
    if len(rows) * len(columns) * 16 > 256 << 20:
        raise ValueError("too many decisions to draw from in one task: fit on clusters or fewer columns")
    k = len(columns)
    s, c = rows[[f"s_{i}" for i in range(k)]].to_numpy(float), rows[[f"c_{i}" for i in range(k)]].to_numpy(float)
    groups = rows[cluster].astype("category").cat.codes.to_numpy() if cluster else np.arange(len(rows))
    shared = spark.sparkContext.broadcast((s, c, groups, seed))

    def run(batches):
        import pandas as pd

        s, c, groups, seed = shared.value
        n = groups.max() + 1 if len(groups) else 0
        for batch in batches:
            out = []
            for r in batch["replicate"]:
                rng = np.random.default_rng([seed, int(r)])
                w = np.bincount(rng.integers(0, n, n), minlength=n)[groups].astype(float)
                beta = _newton(s, c, w)
                out += [(int(r), columns[i], float(beta[i])) for i in range(k)]
            yield pd.DataFrame(out, columns=["replicate", "coefficient", "beta"])

    return spark.range(replicates).withColumnRenamed("id", "replicate").repartition(8).mapInPandas(run, "replicate long, coefficient string, beta double")


def _newton(s: np.ndarray, c: np.ndarray, w: np.ndarray, steps: int = 60) -> np.ndarray:
    """The same likelihood on arrays."""
    theta = np.zeros(s.shape[1] - 1)

    def value(t):
        b = np.exp(np.concatenate([[0.0], t]))
        return float(w @ np.log((c @ b) / (s @ b)))

    now = value(theta)
    for _ in range(steps):
        b = np.exp(np.concatenate([[0.0], theta]))
        cs, ss = c * b / (c @ b)[:, None], s * b / (s @ b)[:, None]
        cs, ss = cs[:, 1:], ss[:, 1:]
        grad = w @ (cs - ss)
        if not len(theta) or np.abs(grad).max() < 1e-8:
            break
        hess = (ss * w[:, None]).T @ ss - (cs * w[:, None]).T @ cs + np.diag(grad)
        low = np.linalg.eigvalsh(-hess).min()
        move = np.linalg.solve(-hess + max(0.0, 1e-8 - low) * np.eye(len(theta)), grad)
        move *= min(1.0, 4.0 / np.abs(move).max())
        scale = 1.0
        while scale > 1e-6 and value(np.maximum(theta + scale * move, -40.0)) <= now:
            scale /= 4
        if scale <= 1e-6:
            break
        theta = np.maximum(theta + scale * move, -40.0)
        now = value(theta)
    return np.exp(np.concatenate([[0.0], theta]))


def interval(draws: np.ndarray, alpha: float = 0.05) -> dict:
    """Percentile interval of replicate betas; at the boundary all of alpha is in the upper tail. The null value is 1."""
    draws = np.asarray(draws, float)
    if np.median(draws) < BOUNDARY:
        upper = float(np.percentile(draws, 100 * (1 - alpha)))
        return {"kind": "one-sided", "lower": 0.0, "upper": upper, "excludes_one": upper < 1}
    lo, hi = np.percentile(draws, [50 * alpha, 100 - 50 * alpha])
    return {"kind": "percentile", "lower": float(lo), "upper": float(hi), "excludes_one": bool(lo > 1 or hi < 1)}


def bca_interval(draws: np.ndarray, point: float, jackknife: np.ndarray, alpha: float = 0.05) -> dict:
    """Bias-corrected and accelerated interval; refused at the boundary, where the statistic is not smooth."""
    from statistics import NormalDist

    draws, leave = np.asarray(draws, float), np.asarray(jackknife, float)
    if point < BOUNDARY:
        raise ValueError("no BCa interval at the boundary")
    normal = NormalDist()
    share = (draws < point).mean() + 0.5 * (draws == point).mean()
    z0 = normal.inv_cdf(min(max(share, 1e-6), 1 - 1e-6))
    off = leave.mean() - leave
    spread = (off**2).sum()
    accel = float((off**3).sum() / (6 * spread**1.5)) if spread > 0 else 0.0
    ends = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(100 * normal.cdf(z0 + z / (1 - accel * z)))
    lo, hi = np.percentile(draws, ends)
    return {"kind": "BCa", "lower": float(lo), "upper": float(hi), "z0": z0, "acceleration": accel}


def percentile_mcse(draws: np.ndarray, q: float, seed: int = 0, repeats: int = 200) -> float:
    """Monte Carlo standard error of a percentile of replicates."""
    rng, draws = np.random.default_rng(seed), np.asarray(draws, float)
    return float(np.std([np.percentile(rng.choice(draws, len(draws)), q) for _ in range(repeats)], ddof=1))
