"""Generalised linear models by iteratively reweighted least squares: the sums of a step are one aggregation.

Families: logit, cloglog (Bernoulli), poisson and negbin (log link, variance mu + alpha mu^2). Cluster-robust covariance by
sums of scores per cluster. A ridge is used where the plain step cannot be solved, and a base rate where data are too few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS, LEAST_EVENTS, RIDGE = 30, 5, 1e-3


@dataclass(frozen=True)
class GlmFit:
    names: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    family: str
    method: str
    alpha: float = 0.0
    rows: int = 0

    def eta(self) -> Column:
        return sum((F.lit(float(b)) * (F.lit(1.0) if n == "const" else F.col(n)) for n, b in zip(self.names, self.beta, strict=True)), F.lit(0.0))

    def mean(self) -> Column:
        return _mean(self.eta(), self.family)[0]

    def any_event(self) -> Column:
        """Probability of at least one event, comparable across families."""
        mu = self.mean()
        if self.family == "poisson":
            return -F.expm1(-mu)
        if self.family == "negbin":
            return 1 - F.pow(1 + self.alpha * mu, F.lit(-1 / self.alpha))
        return mu


def _mean(eta: Column, family: str, alpha: float = 0.0) -> tuple[Column, Column, Column]:
    """Mean, its derivative by eta, and the variance."""
    eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))
    if family == "logit":
        mu = 1 / (1 + F.exp(-eta))
        return mu, mu * (1 - mu), mu * (1 - mu)
    if family == "cloglog":
        mu = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), -F.expm1(-F.exp(eta))))
        return mu, F.exp(eta - F.exp(eta)), mu * (1 - mu)
    mu = F.exp(eta)
    return mu, mu, mu + alpha * mu * mu if family == "negbin" else mu


def _step(rows: DataFrame, names: list[str], y: str, beta: np.ndarray, family: str, alpha: float, cluster: str | None = None):
    """X'WX and the score X'W(y - mu)/mu' of a step; with a cluster, the sum of outer products of cluster scores too."""
    x = [F.lit(1.0) if n == "const" else F.col(n).cast("double") for n in names]
    eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
    mu, slope, var = _mean(eta, family, alpha)
    rows = rows.withColumn("_eta", eta)
    mu, slope, var = _mean(F.col("_eta"), family, alpha)
    rows = rows.withColumns({"_w": slope * slope / var, "_r": (F.col(y).cast("double") - mu) * slope / var})
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    row = rows.agg(*[F.sum(F.col("_r") * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
    grad, info = np.array(row[:k], float), np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k:], strict=True):
        info[i, j] = info[j, i] = v
    if cluster is None:
        return grad, info, None
    scores = rows.groupBy(cluster).agg(*[F.sum(F.col("_r") * c).alias(f"g{i}") for i, c in enumerate(x)])
    row = scores.agg(*[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=True):
        meat[i, j] = meat[j, i] = v
    return grad, info, meat


def fit_glm(rows: DataFrame, y: str, columns: list[str], family: str = "logit", *, cluster: str | None = None, alpha: float = 0.0, steps: int = 50, least: bool = True) -> GlmFit:
    """Fits complete cases. Too few rows or events give the base rate alone (method null)."""
    rows = rows.dropna(subset=[y, *columns]).select(*dict.fromkeys([y, *columns, *([cluster] if cluster else [])])).cache()
    n, events, mean = rows.agg(F.count("*"), F.sum((F.col(y) > 0).cast("long")), F.avg(F.col(y).cast("double"))).first()
    names, events, mean = ["const", *columns], events or 0, mean or 0.0
    link = {"logit": lambda m: np.log(m / (1 - m)), "cloglog": lambda m: np.log(-np.log(1 - m))}.get(family, np.log)
    bounded = family in ("logit", "cloglog")
    start = link(min(max(mean, 1e-6), 1 - 1e-6 if bounded else np.inf))
    if least and (n < LEAST_ROWS or events < LEAST_EVENTS):
        rows.unpersist()
        return GlmFit(("const",), np.array([start]), np.full((1, 1), np.nan), family, "null", alpha, n)
    beta, method = np.zeros(len(names)), "mle"
    beta[0] = start
    if family == "negbin" and not alpha:
        poisson = fit_glm(rows, y, columns, "poisson", least=False)
        mu = poisson.mean()
        over = rows.withColumn("_mu", mu).agg((F.sum((F.pow(F.col(y) - F.col("_mu"), F.lit(2.0)) - F.col("_mu")) / F.col("_mu")) / F.sum("_mu"))).first()[0]
        alpha, beta = max(float(over or 0), 1e-4), poisson.beta.copy()
    for _ in range(steps):
        grad, info, _ = _step(rows, names, y, beta, family, alpha)
        if method == "ridge":
            pen = RIDGE * n * np.eye(len(names))
            pen[0, 0] = 0
            grad, info = grad - pen @ beta, info + pen
        try:
            move = np.linalg.solve(info, grad)
        except np.linalg.LinAlgError:
            move = np.full(len(names), np.nan)
        if not np.isfinite(move).all() or np.abs(beta + move).max() > 1e3:
            if method == "ridge":
                raise ArithmeticError("the model cannot be solved even with a ridge")
            method, beta = "ridge", np.zeros(len(names))
            beta[0] = start
            continue
        beta = beta + move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    _, info, meat = _step(rows, names, y, beta, family, alpha, cluster)
    bread = np.linalg.pinv(info)
    rows.unpersist()
    return GlmFit(tuple(names), beta, bread if meat is None else bread @ meat @ bread, family, method, alpha, n)


def standardised(rows: DataFrame, columns: list[str], train: Column) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns on the training rows' scale (population deviation; 1 where that is 0), for all rows."""
    row = rows.filter(train).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scale = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}), scale
