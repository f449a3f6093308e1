"""Quality classifier: a sparse rule ensemble, compiled to Column expressions.

Statistics of a text are Column expressions (statistics()). For fitting, at most SAMPLE labelled rows, chosen by a hash of
the doc_id, are gathered to the driver with their statistics. Small trees are grown there by boosting on random halves; each
path from a root to a node is a rule, the conjunction of its thresholds. Lasso logistic regression over the rules and the
winsorised statistics, by proximal gradient steps, leaves few non-zero weights. The rules left and their weights become one
Column: scoring a corpus is a single scan without Python.

Null texts count as empty and are scored like them. Labels outside 0 and 1, null labels and labels of unknown documents are
not learned from; where a document has several labels the smallest counts, and of rows that share a labelled doc_id the one with the least statistics. Repeated rows are scored each. Without labels of
both kinds the score is their share (0.5 without labels). Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm._common import WORD

#: The most labelled rows that are fitted on; trees, their depth, and the lasso's penalty.
SAMPLE, TREES, TREE_DEPTH, PENALTY = 20_000, 40, 3, 2e-3
PARTS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % PARTS


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, by name. Shares are of characters, or of words where named so."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    by_words = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("distinct"))), F.lit(0))
    lines = F.get(F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("distinct"))), F.lit(0))
    return {
        "chars": F.length(text).cast("double"), "words": by_words, "lines": lines,
        "symbols": count("[#*$%&<>{}=_^~\\\\]"), "bars": count("\\|"), "marks": count("!"), "upper": count("\\p{Lu}"),
        "digits": count("[0-9]"), "stops": count("[.!?]"), "commas": count("[,;:]"),
    }


NAMES = ("log_chars", "log_words", "word_length", "distinct_share", "repeat_share", "line_words", "line_repeat", "symbol_share", "bar_share", "mark_share", "upper_share", "digit_share", "stop_share", "comma_share")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics NAMES, as doubles."""
    s = statistics(F.col("text"))
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(f"_{n}") for n, c in s.items()])
    chars, n, distinct = F.greatest("_chars", F.lit(1.0)), F.greatest("_words.n", F.lit(1.0)), F.col("_words.distinct")
    share = lambda c: F.col(c) / chars
    return raw.select(
        "doc_id", F.log1p("_chars").alias("log_chars"), F.log1p("_words.n").alias("log_words"), (F.col("_chars") / n).alias("word_length"),
        (distinct / n).alias("distinct_share"), (F.log1p(distinct) / F.log1p(n)).alias("repeat_share"), F.log1p(n / F.col("_lines.n")).alias("line_words"), (F.col("_lines.distinct") / F.col("_lines.n")).alias("line_repeat"),
        share("_symbols").alias("symbol_share"), share("_bars").alias("bar_share"), share("_marks").alias("mark_share"), share("_upper").alias("upper_share"), share("_digits").alias("digit_share"), share("_stops").alias("stop_share"), share("_commas").alias("comma_share"),
    )


Rule = tuple[tuple[int, bool, float], ...]  # conditions: statistic, whether above, threshold


@dataclass(frozen=True)
class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of rules that hold + sum of linear terms)."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[int, float, float, float], ...]  # statistic, weight, lower and upper winsor bound

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, above, t in rule:
                holds = holds & (F.col(NAMES[k]) > t if above else F.col(NAMES[k]) <= t)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        for k, weight, lo, hi in self.linear:
            total = total + F.lit(weight) * F.least(F.lit(hi), F.greatest(F.lit(lo), F.col(NAMES[k])))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * _holds(x, rule)
        for k, weight, lo, hi in self.linear:
            total += weight * np.clip(x[:, k], lo, hi)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, rows: np.ndarray, depth: int, rule: Rule, out: list[Rule], f: np.ndarray, least: int) -> None:
    """A regression tree on gradients by binned splits; adds every path to out and the leaves' means to f."""
    best, gain = None, 1e-9
    total, n = g[rows].sum(), len(rows)
    if depth and n >= 2 * least:
        for k in range(x.shape[1]):
            b = bins[rows, k]
            sums, counts = np.bincount(b, g[rows], len(edges[k]) + 1)[:-1].cumsum(), np.bincount(b, minlength=len(edges[k]) + 1)[:-1].cumsum()
            ok = (counts >= least) & (n - counts >= least)
            if ok.any():
                score = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1), -np.inf) - total**2 / n
                j = int(score.argmax())
                if score[j] > gain:
                    best, gain = (k, j), float(score[j])
    if best is None:
        f[_holds(x, rule)] += total / max(n, 1)
        return
    k, j = best
    t = float(edges[k][j])
    left = bins[rows, k] <= j
    for above, part in ((False, rows[left]), (True, rows[~left])):
        path = (*rule, (k, above, t))
        out.append(path)
        _grow(x, bins, edges, g, part, depth - 1, path, out, f, least)


def _simplified(rule: Rule) -> Rule:
    """One condition per statistic and direction, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, t in rule:
        old = tight.get((k, above))
        tight[k, above] = t if old is None else (max(old, t) if above else min(old, t))
    return tuple(sorted((k, above, t) for (k, above), t in tight.items()))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = TREE_DEPTH, penalty: float = PENALTY, seed: int = 7, steps: int = 600) -> RuleEnsemble:
    """Grows trees, takes their paths as rules, and fits lasso logistic weights."""
    if not len(y) or y.min() == y.max():
        share = (y.mean() if len(y) else 0.5).clip(1e-3, 1 - 1e-3) if len(y) else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))), (), ())
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    found: list[Rule] = []
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    least = max(5, len(y) // 400)
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        _grow(x, bins, edges, g, np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False)), depth, (), found, step, least)
        f += 1.5 * step
    rules, columns, seen = [], [], set()
    for rule in dict.fromkeys(_simplified(r) for r in found):
        holds = _holds(x, rule)
        key = holds.tobytes()
        if 0 < holds.sum() < len(y) and key not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(holds.astype(np.float64))
    lo, hi = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    z = np.clip(x, lo, hi)
    spread = z.std(axis=0)
    m = np.column_stack([*columns, 0.4 * (z - z.mean(axis=0)) / np.where(spread > 0, spread, 1)])
    centre = m.mean(axis=0)
    m = m - centre
    # accelerated proximal gradient; the intercept is not penalised
    w, b = np.zeros(m.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    v0 = rng.standard_normal(m.shape[1])
    for _ in range(20):
        v0 = m.T @ (m @ v0)
        v0 /= np.linalg.norm(v0)
    rate = 1 / (0.25 * (np.linalg.norm(m @ v0) ** 2 / len(y) + 1) * 1.05)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(m @ v + vb))) - y
        new = v - rate * (m.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = vb - rate * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    kept = tuple((rule, float(c)) for rule, c in zip(rules, w[: len(rules)], strict=True) if c)
    linear, shift = [], float(b - centre @ w)
    for k, c in enumerate(w[len(rules) :]):
        if c and spread[k] > 0:
            scale = 0.4 * c / spread[k]
            linear.append((k, float(scale), float(lo[k]), float(hi[k])))
            shift -= scale * float(z[:, k].mean())
    return RuleEnsemble(shift, kept, tuple(linear))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> RuleEnsemble:
    """Fits on at most sample labelled rows whose remainder is not HELD_OUT; the bound is the only one."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.min("quality").cast("double").alias("quality"))
    known = known.filter(_remainder(F.col("labelled")) != HELD_OUT)
    # the rows of least hash: TakeOrdered keeps this many per task
    chosen = known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    # one row per labelled document, so the bound holds where a doc_id has many rows
    once = features(texts).groupBy("doc_id").agg(F.min(F.struct(*NAMES)).alias("of")).select("doc_id", "of.*")
    rows = once.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select(*NAMES, "quality").toArrow()
    data = np.column_stack([rows.column(c).to_numpy() for c in (*NAMES, "quality")]) if len(rows) else np.empty((0, len(NAMES) + 1))
    data = data[np.lexsort(data.T)]  # the order of arrival must not matter
    return fit(data[:, :-1], data[:, -1])


def classify(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = features(docs).withColumn("score", model.column())
    return scored.select("doc_id", (_remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
