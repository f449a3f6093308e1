"""White-space races and activation portfolios against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.operators import metrics, siting, white_space


def test_paired_test_as_a_column(spark):
    cases = [(0, 0), (1, 9), (5, 5), (0, 7), (30, 12), (700, 640), (3000, 3100)]
    rows = spark.createDataFrame(cases, "a long, b long").select("a", "b", white_space.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        if r.a + r.b == 0:
            assert r.p is None
        else:
            assert r.p == pytest.approx(metrics.mcnemar_exact(r.a, r.b), abs=1e-9)


def test_race_by_hand(spark):
    """Two served places and two that no site is near; the opening lies in the larger unserved one."""
    places = spark.createDataFrame([(1, 1, 900.0, 40.0, -90.0), (2, 1, 500.0, 40.0, -90.001), (3, 2, 400.0, 41.0, -91.0), (4, None, 300.0, 42.0, -92.0)], "place long, group long, households double, lat double, lon double")
    sites = spark.createDataFrame([(7, 40.0, -90.0)], "site long, site_lat double, site_lon double")
    scores = white_space.rule_scores(places, sites, 3.0)
    got = {r.place: r for r in scores.collect()}
    assert [got[k].white_space for k in (1, 2, 3, 4)] == [None, None, 400.0, 300.0]
    assert [got[k].demand_in_radius for k in (1, 2, 3, 4)] == [1400.0, 1400.0, 400.0, 300.0]
    assert [got[k].load_per_facility for k in (1, 3)] == [700.0, 400.0] and got[1].coverage_gain == 0.0
    openings = spark.createDataFrame([(1, 3), (2, 4)], "opening long, place long")
    races = white_space.race(scores, openings, {"place": (1, 3), "group": (1,)})
    cells = {(r.level, r.rule, r.n): r for r in races.collect()}
    assert cells["place", "white_space", 1].hits == 1 and cells["place", "households", 1].hits == 0 and cells["place", "white_space", 1].p == 1.0
    assert cells["place", "households", 3].hits == 1 and cells["place", "households", 3].p is None and cells["place", "white_space", 1].groups == 1
    assert cells["group", "households", 1].openings == 1  # a place without a group has no opening there
    board = white_space.scoreboard(races).first()
    assert (board.cells, board.wins, board.sure_wins) == (3, 3, 0) and board.verdict.startswith("beats")
    assert white_space.multiplicity(races).first().in_favour == 0
    empty = white_space.race(scores, openings.limit(0), {"place": (1,), "group": (1,)})
    assert empty.count() == 0 and white_space.scoreboard(empty).first().win_share == 0.0


def test_activation_against_enumeration(spark):
    rng = np.random.default_rng(3)
    terms = siting.Activation(capital=50.0, years=5, rate=0.1)
    for _ in range(6):
        n, k = 8, 3
        parcels, cost = rng.uniform(20, 90, n), rng.uniform(10, 60, n)
        linehaul = cost * rng.uniform(0.1, 0.5, n)
        o = np.triu(rng.uniform(0, 1, (n, n)) * (rng.random((n, n)) < 0.4), 1)
        o = o + o.T
        near = [(np.flatnonzero(o[j]), o[j][np.flatnonzero(o[j])]) for j in range(n)]

        def worth(c, margin, parcels=parcels, cost=cost, linehaul=linehaul, o=o):
            c = list(c)
            d = 1 - np.exp(-o[np.ix_(c, c)].sum(axis=1))
            a = (parcels[c] * (1 - terms.lost * d)).sum() * terms.annuity
            return margin * a - (cost[c] - linehaul[c] * terms.shared * d).sum() * terms.annuity - len(c) * terms.capital, a

        for margin in (0.5, 1.5, 3.0):
            chosen, npv = siting.activate(parcels, cost, linehaul, near, k, margin, terms)
            best = max(worth(c, margin)[0] for r in range(k + 1) for c in itertools.combinations(range(n), r))
            assert len(chosen) <= k and npv == pytest.approx(worth(chosen, margin)[0]) and best * 0.9 - 1e-9 <= npv <= best + 1e-9
            v = siting.activation_value(parcels, cost, linehaul, near, chosen, terms)
            assert margin * v["per_margin"] + v["fixed"] == pytest.approx(npv)
    a, b = parcels * terms.annuity, (cost - linehaul * terms.shared) * terms.annuity + terms.capital
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    least = min(b[list(c)].sum() / a[list(c)].sum() for c in itertools.combinations(range(n), k))
    assert siting.ratio_bound(rows, "a", "b", k) == pytest.approx(least)
    assert siting.activation_value(parcels, cost, linehaul, near, [], terms)["breakeven"] == float("inf")


def test_check_report(spark):
    from gridfold.operators.quality import check_report

    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    got = {r.name: (r.level, r.n, r.ok) for r in check_report(df, ["k"], {"odd": F.col("v") == "a"}, {"none": F.col("v").isNull()}, {"rows": F.lit(True)}).collect()}
    assert got == {"odd": ("error", 1, False), "none": ("warning", 1, None), "rows": ("stat", 2, None)}
    assert check_report(df, ["z"], {}).first().name == "missing column z"


def test_large_blocks_lose_no_match(spark):
    """Groups from small blocks and finer ones are those of all pairs."""
    from gridfold.operators import linkage
    from gridfold.operators.components import components
    from gridfold.operators.storage import shared_dir

    rng = np.random.default_rng(11)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    rows = [(k, f"{pick(10, 12)} {pick('MAPLE', 'MAPEL', 'GRANT LINE')} {pick('RD', 'ROAD', 'ST')}", pick("A", "B", ""), pick("S1", "S2", ""), pick("00001", "00002", "00003"), pick("", "", "", "", "DWS1", "DWS2")) for k in range(90)]
    r = linkage.link_records(spark.createDataFrame(rows, "rid long, street string, city string, state string, zip string, code string")).cache()
    whole = linkage.candidate_pairs(r, largest=1000)
    finer, left = linkage.large_block_pairs(r, largest=12)
    assert left.isEmpty() and not linkage.skipped_blocks(r, 12).isEmpty()

    def groups(pairs):
        matches = linkage.compare(pairs, r).filter("call = 'match'").select("a", "b")
        return {(x.node, x.component) for x in components(matches, shared_dir(spark, "groups")).collect()}

    both = linkage.candidate_pairs(r, 12).unionByName(finer).distinct()
    assert groups(both) == groups(whole) and both.count() < whole.count()


def test_splits_and_their_report(spark):
    from gridfold.operators import resample

    df = spark.createDataFrame([(u, t, u == 3 and t == 9) for u in range(40) for t in (1, 9)] + [(77, None, None)], "unit long, t long, event boolean")
    by_time = {r.split: (r.rows, r.units, r.events, r.eventless) for r in resample.split_report(resample.split_by_time(df, "t", 5), "unit", "event").collect()}
    assert by_time == {"train": (40, 40, 0, True), "test": (40, 40, 1, False), None: (1, 1, 0, True)}
    parts = resample.split(df, "unit", {"a": 0.5, "b": 0.5}, u=F.col("unit") / 80)
    assert {r.split: r.units for r in resample.split_report(parts, "unit", "event").collect()} == {"a": 40, "b": 1}
