"""Decisions that share their alternatives: the same results as with all of them listed, without a row per decision and alternative."""

from __future__ import annotations

import numpy as np
import pytest

from gridfold.operators import choice

COLUMNS, BETA = ["a", "b"], [1.0, 3.0]


@pytest.fixture(scope="module")
def both(spark):
    """Two markets with ties, a place that several chose and one that none did; listed and shared."""
    rng = np.random.default_rng(3)
    members = [(m, 10 * m + k, float(rng.integers(1, 4)), float(rng.integers(0, 3))) for m, n in ((1, 9), (2, 4)) for k in range(n)]
    made = [(d, 1 + d % 2, 10 * (1 + d % 2) + int(rng.integers(0, 3 if d % 2 else 8))) for d in range(30)]
    rows = [(d, alt, m, alt == pick, a, b) for d, m, pick in made for k, alt, a, b in members if k == m]
    listed = choice.Listed(spark.createDataFrame(rows, "decision long, alt long, market long, chosen boolean, a double, b double"), "decision", "alt", "chosen")
    shared = choice.Shared(spark.createDataFrame(made, "decision long, market long, alt long"), spark.createDataFrame(members, "market long, alt long, a double, b double"), "decision", "market", "alt")
    return choice.scored(listed, COLUMNS, BETA), choice.scored(shared, COLUMNS, BETA)


def joined_rows(df) -> int:
    """The most rows that an operator of the plan made."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            plan.append(node.plan())
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
    return most


def test_ranks_of_shared_choices(both):
    get = lambda c: sorted((r.decision, r.alt, round(r.p, 12), r["rank"], round(r.cumulative, 12), r.alternatives) for r in c.ranks().collect())
    listed, shared = both
    assert get(listed) == get(shared) and len(get(shared)) == 30


def test_strata_lift_makes_no_pairs(spark):
    """1500 customers of a market's size squared before."""
    from gridfold.plans.catalog import QUERIES

    assert joined_rows(QUERIES["strata_lift"](spark, "/root/testdata/sf0.01")) <= 1500


def close(a, b) -> bool:
    return list(a) == list(b) and np.allclose(list(a.values()), list(b.values()), rtol=1e-9, atol=1e-12)


def test_scores_of_shared_choices(both):
    """F4."""
    listed, shared = (c.evaluate().first().asDict() for c in both)
    assert close(listed, shared)


def test_zones_merged_once_per_market(both):
    """F3."""
    from dataclasses import replace

    from gridfold.operators import resample

    listed, shared = both
    rows = resample.merge_zones(listed.rows, "decision", "alt", "chosen", COLUMNS)
    means = [choice.scored(c, COLUMNS, BETA).evaluate().first().asDict() for c in (replace(listed, rows=rows), resample.merge_shared_zones(shared, COLUMNS))]
    assert close(*means)


def test_fits_of_shared_choices(both):
    """the same splits, fits and held-out scores."""
    from gridfold.operators import resample

    a, b = (resample.forward_selection(c, ["a"], ["b"]) for c in both)
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])
    a, b = (resample.ablation(c, ["a"], "b", repeats=1).first().asDict() for c in both)
    assert close(a, b)


def test_boosted_trees_on_weighted_rows(both):
    """F8: an alternative's rows are one per label, with their number."""
    from gridfold.operators import resample

    listed, shared = both
    total = lambda c: sorted((r.a, r.b, r.y, r.w) for r in c.examples(COLUMNS).groupBy("a", "b", "y").agg({"w": "sum"}).withColumnRenamed("sum(w)", "w").collect())
    assert total(listed) == total(shared) and shared.examples(COLUMNS).count() < listed.examples(COLUMNS).count()
    a, b = (resample.boosted_benchmark(c, COLUMNS).first().asDict() for c in both)
    assert close(a, b)


@pytest.mark.parametrize("name", ["choice_topk", "choice_probs", "conformal_sets", "zone_merge"])
def test_choice_queries_make_no_pairs(spark, name):
    """F3, F4, F10, F11."""
    from gridfold.plans.catalog import QUERIES

    assert joined_rows(QUERIES[name](spark, "/root/testdata/sf0.01")) <= 1500
