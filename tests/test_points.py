"""Sums over all places and sites go by distinct points."""

from __future__ import annotations

import numpy as np
import pytest

from gridfold.operators import siting
from tests.test_choice_sets import joined_rows


@pytest.mark.parametrize("name", ["gravity_terms", "network_vintages"])
def test_pairs_of_points_not_of_rows(spark, name):
    """15,000 places stand on 1200 points (12,000 with their county); before, all 15,000,000 pairs with 1000 sites were made."""
    from gridfold.plans.catalog import QUERIES

    assert joined_rows(QUERIES[name](spark, "/root/testdata/sf0.1")) < 12_000_000


def test_portfolio_reads_few_lists():
    """neighbours are worked out for sites that are or were chosen; before, all sites' lists were held, here 4,000 lists of thousands."""
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(40, 40.3, 4000), rng.uniform(-90, -89.7, 4000)
    value, cost = rng.uniform(1, 9, 4000), rng.uniform(1, 3, 4000)
    near = siting.Within(lat, lon, 30.0, lambda miles: 0.3 * np.exp(-miles / 5))
    chosen, total = siting.portfolio(value, cost, near, 12.0)
    assert len(chosen) <= len(near.lists) < 100
    some = np.arange(300)
    few = siting.Within(lat[some], lon[some], 5.0, lambda miles: 0.3 * np.exp(-miles / 5))
    m = siting.miles_matrix(lat[some], lon[some], lat[some], lon[some])
    lists = [(k := np.flatnonzero((m[j] <= 5) & (some != j)), 0.3 * np.exp(-m[j, k] / 5)) for j in some]
    a, b = siting.portfolio(value[some], cost[some], few, 12.0), siting.portfolio(value[some], cost[some], lists, 12.0)
    assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_p_median_reads_distances_a_few_times():
    """before, each opening and each try of a swap read all distances: more than 100 times here."""
    rng = np.random.default_rng(5)
    n, read = 400, 0

    class Counted(siting.Miles):
        def columns(self, which):
            nonlocal read
            out = super().columns(which)
            read += out.size
            return out

        def rows(self, which):
            nonlocal read
            out = super().rows(which)
            read += out.size
            return out

    siting.p_median(Counted(rng.uniform(38, 42, n), rng.uniform(-90, -84, n)), rng.uniform(1, 9, n), 50)
    assert read < 40 * n * n


def test_depots_count_points_once(spark):
    """places of one point share a depot, until there are more depots than points."""
    rows = spark.createDataFrame([(1, k, 40.0 + k % 3, -90.0, 10.0) for k in range(12)], "area long, place long, lat double, lon double, parcels double")
    depots = lambda per: sorted((r.depot, r.depots, r.objective) for r in siting.depot_network(rows, "area", per_depot=per).collect())
    assert depots(40.0) == [(0, 3, 0.0), (1, 3, 0.0), (2, 3, 0.0)]
    assert [d[0] for d in depots(24.0)] == [0, 1, 2, 3, 4]
