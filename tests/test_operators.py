from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.functions import fields
from gridfold.operators import allocate, asof, capture, choice, cost, geo, glm, hazard, linkage, metrics, quality, resample, siting
from gridfold.operators.components import components
from gridfold.operators.storage import shared_dir
from gridfold.plans import panel


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (8, 9), (3, 1)], "a long, b long")
    assert dict(map(tuple, components(edges, shared_dir(spark, "t")).collect())) == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


@pytest.mark.parametrize("miles", [3.0, 40.0, 400.0])
def test_radius_join_against_all_pairs(spark, miles):
    rng = np.random.default_rng(0)
    a = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-80, 80, 150), rng.uniform(-180, 180, 150), strict=True))] + [(200, 10.0, 179.99), (201, 60.0, 0.0)]
    b = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-80, 80, 90), rng.uniform(-180, 180, 90), strict=True))] + [(300, 10.0, -179.99), (301, 60.01, 0.01)]
    left, right = spark.createDataFrame(a, "p long, lat double, lon double"), spark.createDataFrame(b, "s long, site_lat double, site_lon double")
    got = sorted((r.p, r.s) for r in geo.radius_join(left, right, miles).collect())
    m = siting.miles_matrix(*(np.array(x) for x in zip(*[(r[1], r[2]) for r in a], strict=True)), *(np.array(x) for x in zip(*[(r[1], r[2]) for r in b], strict=True)))
    assert got == sorted((a[i][0], b[j][0]) for i, j in zip(*np.nonzero(m <= miles), strict=True))
    assert (200, 300) in got


def test_nearest_by_rings_equals_broadcast(spark):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(30, 45, (60, 2)))], "p long, lat double, lon double")
    right = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(30, 45, (25, 2)))], "s long, site_lat double, site_lon double")
    whole = {r.p: r.s for r in geo.nearest(left, right, "s").collect()}
    rings = {r.p: r.s for r in geo.nearest(left, right, "s", broadcast_sites=5).collect()}
    assert whole == rings and None not in whole.values()


def test_nearest_by_rings_reaches_the_whole_sphere(spark):
    """A site on the other side, a pole, the date line, and a row whose condition no site meets."""
    left = spark.createDataFrame([(1, 10.0, 20.0, 0), (2, -9.0, -159.0, 0), (3, 89.5, 0.0, 0), (4, 10.0, 179.9, 7)], "p long, lat double, lon double, own int")
    right = spark.createDataFrame([(k, -10.0 - k / 100, -160.0, 7) for k in range(8)], "s long, site_lat double, site_lon double, site_own int")
    other = F.col("own") != F.col("site_own")
    whole = {r.p: (r.s, r.miles) for r in geo.nearest(left, right, "s", other=other, same=("own",)).collect()}
    rings = {r.p: (r.s, r.miles) for r in geo.nearest(left, right, "s", other=other, same=("own",), broadcast_sites=5).collect()}
    assert whole == rings and whole[4] == (None, None) and whole[1][1] > 11_000



def test_latest_before_is_strict(spark):
    d = spark.createDataFrame([("k", 2018), ("k", 2017), ("k", 2020), ("z", 2020)], "k string, t long")
    v = spark.createDataFrame([("k", 2017, 1.0), ("k", 2018, 2.0)], "k string, y long, v double")
    assert sorted((r.t, r.y_used, r.v) for r in asof.latest_before(d, v, ["k"], "t", "y", ["v"]).collect()) == [(2018, 2017, 1.0), (2020, 2018, 2.0)]


def test_panel_is_dense_and_calendar_wise(spark):
    entities = spark.createDataFrame([("01890",), ("02135",)], "zcta string")
    facts = spark.createDataFrame([("01890", 2021, 1, 1000.0), ("01890", 2022, 1, 1100.0), ("01890", 2022, 2, 5.0)], "zcta string, year long, quarter long, rent double")
    got = panel.build_panel(entities, panel.dim_quarter_of(spark, 2021, 2022), facts, "zcta", "rent")
    quality.check_grain(got, ["zcta", "date_id"])
    rows = {(r.zcta, r.date_id): r for r in got.collect()}
    assert len(rows) == 16
    assert rows["01890", "2022Q1"].rent_yoy_pct == pytest.approx(10) and rows["01890", "2022Q2"].rent_yoy_pct is None
    assert not rows["02135", "2021Q1"].rent_observed
    with pytest.raises(quality.ContractError):
        quality.check_grain(facts, ["zcta"])


def test_panel_write_and_optional_block(spark, tmp_path):
    facts = spark.createDataFrame([("a", 2021, 3.0, "x"), ("a", 2021, 5.0, "y")], "zcta string, year int, v double, label string")
    block = panel.optional_block(facts, "zcta", [])
    assert [tuple(r) for r in block.collect()] == [("a", 2021, 4.0)]
    assert panel.optional_block(facts.drop("year"), "zcta", []) is None
    panel.write_panel(block, str(tmp_path / "p"), ["zcta", "year"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("year = 2021").count() == 1


def test_quality(spark):
    df = spark.createDataFrame([(1, 250001.0), (2, None), (3, 10.0)], "k int, income double")
    flagged = quality.flag_sentinels(df, [quality.Sentinel("income", "TOP", "income_topcoded", 250001), quality.Sentinel("income", "ABSENT", "income_imputed")])
    assert [(r.income_topcoded, r.income_imputed) for r in flagged.orderBy("k").collect()] == [(True, False), (False, True), (False, False)]
    quality.flag_gate({"s": flagged}, flagged)
    with pytest.raises(quality.ContractError, match="income_imputed"):
        quality.flag_gate({"s": flagged}, df)
    assert quality.check_schema(df, ["k"], {"k": [1, 2]}, {"positive": F.col("income") > 100}) == {"k outside its vocabulary": 1, "positive": 1}
    with pytest.raises(quality.ContractError):
        quality.check_schema(df, ["absent"])


def test_risk_set(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, True), (2, 2, False), (3, 2, False)], "u int, t int, e boolean")
    out = hazard.risk_set(df, "u", "t", "e", 1)
    assert sorted((r.u, r.t) for r in out.collect()) == [(1, 2), (3, 2)]
    hazard.check_risk_set(out, "u", "t", "e")
    with pytest.raises(quality.ContractError):
        hazard.check_risk_set(df, "u", "t", "e")


def test_cost_by_hand(spark):
    row = spark.createDataFrame([(1000.0, None, 10.0, 45000.0, 4.0, 10.0), (0.0, 75000.0, 0.0, 45000.0, 4.0, None)], "households double, income double, land double, wage double, diesel double, linehaul double")
    a, b = cost.evaluate(row).collect()
    parcels = 1000 * 3.2 / 6
    stops = parcels / 1.4
    miles = 0.57 / math.sqrt(stops / 10) * 1.3 + 2 * 13 / 120
    hourly = 45000 * 1.32 / 2808
    want = miles * (4 / 14 + 0.19) + miles / 22 * hourly + 2.4 / 60 * hourly + 41 / 120
    assert a.income_imputed and a.cost_per_stop == pytest.approx(want) and a.vans == math.ceil(stops / 120)
    assert b.cost_per_stop is None and b.linehaul_miles == 25.0


def _links(spark, rows):
    return linkage.link_records(spark.createDataFrame(rows, "rid long, street string, city string, state string, zip string, code string")).cache()


@pytest.mark.parametrize(
    ("a", "b", "call"),
    [
        (("100 MAIN ST", "X", "CA", "90001", ""), ("100 Main Street", "X", "CA", "90001", ""), "match"),
        (("100 MAIN ST", "X", "CA", "90001", ""), ("100 Main Street", "X", "NV", "90001", ""), "nonmatch"),
        (("100 MAIN ST", "X", "CA", "90001", ""), ("102 Main Street", "X", "CA", "90001", ""), "nonmatch"),
        (("100 N MAIN ST", "X", "CA", "90001", ""), ("100 S MAIN ST", "X", "CA", "90001", ""), "nonmatch"),
        (("100 MAIN ST", "X", "CA", "90001", ""), ("100 MAIN RD", "X", "CA", "90001", ""), "review"),
        (("100 MAIN ST", "X", "CA", "90001", ""), ("100 MAIN ST", "Y", "CA", "90002", ""), "review"),
        (("", "X", "CA", "90001", ""), ("100 MAIN ST", "X", "CA", "90001", ""), "review"),
        (("100 MAIN ST", "X", "CA", "90001", "DWS4"), ("7 OTHER RD", "Y", "CA", "90001", "DWS4"), "match"),
        (("100 MAIN ST", "X", "CA", "90001", "DWS4"), ("100 MAIN ST", "X", "CA", "90001", "DWS5"), "nonmatch"),
        (("100 GRANT LINE RD", "X", "CA", "", ""), ("100 GRANTLINE RD", "X", "CA", "", ""), "match"),
    ],
)
def test_verdicts(spark, a, b, call):
    r = _links(spark, [(1, *a), (2, *b)])
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    assert linkage.compare(pair, r).first().call == call


def test_groups_are_repaired(spark):
    rows = [(1, "100 N MAIN ST", "X", "CA", "90001", ""), (2, "100 MAIN ST", "X", "CA", "90001", ""), (3, "100 S MAIN ST", "X", "CA", "90001", ""), (4, "9 OAK RD", "X", "CA", "90001", ""), (5, "9 OAK ROAD", "X", "CA", "90001", "")]
    r = _links(spark, rows)
    got = {x.rid: (x.group, x.ambiguous) for x in linkage.groups(r, linkage.compare(linkage.candidate_pairs(r), r)).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, False), 5: (4, False)}


def test_adjudication(spark):
    rows = spark.createDataFrame([("g", "2020-01", 1), ("g", "2021-01", 2), ("h", "2020-01", 1), ("h", "2021-01", 1), ("i", "2020-01", 3)], "g string, d string, r int")
    got = {x.g: (x.resolved, x.unresolved) for x in linkage.adjudicate(rows, "g", "d", "r").collect()}
    assert got == {"g": ("2020-01", False), "h": (None, True), "i": ("2020-01", False)}
    with pytest.raises(ValueError, match="unresolved"):
        linkage.require_resolved(linkage.adjudicate(rows, "g", "d", "r"))


def test_choice_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    true, rows = np.array([1.0, 3.0]), []
    for d in range(1500):
        x = rng.uniform(1, 10, (6, 2))
        u = x @ true
        pick = rng.choice(6, p=u / u.sum())
        rows += [(d, j, bool(j == pick), float(x[j, 0]), float(x[j, 1]), d % 40) for j in range(6)]
    df = spark.createDataFrame(rows, "decision long, alt long, chosen boolean, a double, b double, metro long")
    f = choice.fit(df, "decision", "chosen", ["a", "b"], cluster="metro")
    assert f.beta[0] == 1 and 1.5 < f.beta[1] < 6
    assert f.covariance is not None and f.covariance[0, 0] > 0 and 0 < f.rho2 < 1
    draws = choice.bootstrap(df, "decision", "chosen", ["a", "b"], replicates=16, seed=1).filter("coefficient = 'b'").toPandas().beta.to_numpy()
    assert choice.interval(draws)["lower"] < f.beta[1] < choice.interval(draws)["upper"] * 1.5
    assert choice.percentile_mcse(draws, 97.5) >= 0
    assert choice.bca_interval(draws, float(f.beta[1]), draws[:8])["kind"] == "BCa"
    p = choice.probabilities(df, "decision", ["a", "b"], [1.0, 3.0]).groupBy("decision").agg(F.sum("p").alias("p"))
    assert p.filter("abs(p - 1) > 1e-9").isEmpty()


def test_boundary_is_flagged(spark):
    rows = [(d, j, j == 0, 1.0 + (j == 0), 1.0 + 9 * (j == 1)) for d in range(40) for j in range(3)]
    f = choice.fit(spark.createDataFrame(rows, "d long, alt long, chosen boolean, a double, b double"), "d", "chosen", ["a", "b"])
    assert f.at_boundary[1] and f.covariance is None
    with pytest.raises(ValueError):
        choice.bca_interval(np.zeros(5), 0.0, np.zeros(5))


@pytest.mark.parametrize("family", ["logit", "poisson", "negbin", "cloglog"])
def test_glm_recovers(spark, family):
    rng = np.random.default_rng(4)
    x = rng.normal(size=3000)
    eta = -0.4 + 0.8 * x
    if family == "logit":
        y = rng.random(3000) < 1 / (1 + np.exp(-eta))
    elif family == "cloglog":
        y = rng.random(3000) < -np.expm1(-np.exp(eta))
    elif family == "poisson":
        y = rng.poisson(np.exp(eta))
    else:
        y = rng.poisson(np.exp(eta) * rng.gamma(2, 0.5, 3000))
    df = spark.createDataFrame([(float(a), int(b), k % 50) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y int, c int")
    f = glm.fit_glm(df, "y", ["x"], family, cluster="c")
    assert f.method == "mle" and abs(f.beta[0] + 0.4) < 0.15 and abs(f.beta[1] - 0.8) < 0.15
    assert (np.diag(f.covariance) > 0).all()
    if family == "negbin":
        assert 0.2 < f.alpha < 1.0
    few = glm.fit_glm(df.limit(5), "y", ["x"], family)
    assert few.method == "null"


def test_glm_separation_uses_a_ridge(spark):
    df = spark.createDataFrame([(float(k), int(k >= 50)) for k in range(100)], "x double, y int")
    f = glm.fit_glm(df, "y", ["x"], "logit")
    assert f.method in ("ridge", "mle") and np.isfinite(f.beta).all()


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "p double, y boolean")
    assert metrics.auc(df, "p", "y").first().auc == pytest.approx(0.875)
    assert metrics.auc(df.filter("y"), "p", "y").first().auc is None
    assert metrics.brier_skill(df, "p", "y").first().brier == pytest.approx((0.01 + 0.36 + 0.16 + 0.01) / 4)
    assert metrics.conformal_quantile(df, "p", 0.4) == 0.4
    assert metrics.conformal_quantile(df, "p", 0.01) == math.inf
    assert metrics.mcnemar_exact(1, 9) == pytest.approx(2 * 11 / 1024)
    assert metrics.mcnemar_exact(0, 0) == 1.0
    bins = metrics.calibration(df, "p", "y", bins=2, strategy="uniform")
    assert metrics.expected_calibration_error(bins).first().ece == pytest.approx((3 * abs(0.3 - 1 / 3) + abs(0.9 - 1)) / 4)


def test_capture_goldens():
    assert capture.lincoln_petersen(208, 340, 112) == pytest.approx(631.4286, abs=1e-4)
    assert capture.chapman(208, 340, 112)[0] == pytest.approx(629.6991, abs=1e-4)
    assert capture.chao(436, 324, 112)[0] == pytest.approx(899.0619, abs=1e-4)
    lo, hi = capture.lognormal_interval(899.0619, 436, capture.chao(436, 324, 112)[1])
    assert 436 < lo < 899.0619 < hi
    assert capture.odds_ratio(1, 0, 2, 3) == math.inf
    with pytest.raises(ValueError):
        capture.lincoln_petersen(1, 1, 0)


def test_loglinear_recovers_independence():
    n, p = 10_000, (0.3, 0.4, 0.5)
    cells = {k: n * math.prod(q if b else 1 - q for q, b in zip(p, k, strict=True)) for k in itertools.product((0, 1), repeat=3) if any(k)}
    fits = capture.loglinear(cells)
    assert len(fits) == 8
    assert fits["[1][2][3]"]["unseen"] == pytest.approx(n * 0.7 * 0.6 * 0.5, rel=1e-6)
    assert fits["[12][13][23]"]["df"] == 0 and fits["[12][13][23]"]["deviance"] == pytest.approx(0, abs=1e-6)


def test_p_median_against_enumeration():
    rng = np.random.default_rng(6)
    exact = 0
    for _ in range(20):
        xy, w = rng.uniform(0, 10, (9, 2)), rng.uniform(1, 5, 9)
        d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        best = min(float((w * d[:, list(c)].min(axis=1)).sum()) for c in itertools.combinations(range(9), 3))
        got = float((w * d[:, siting.p_median(d, w, 3)].min(axis=1)).sum())
        assert got < 1.12 * best
        exact += got < best + 1e-9
    assert exact >= 15
    assert siting.p_median(np.array([[0.0, 50], [50, 0]]), np.array([60, 40]), 1).tolist() == [0]


def test_depots_of_large_areas_are_solved_by_blocks(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(k % 2, k, float(x), float(y), 10.0 + k % 5) for k, (x, y) in enumerate(rng.uniform(38, 40, (700, 2)))], "area long, place long, lat double, lon double, parcels double")
    order = lambda df: sorted((r.area, r.depot, r.depots, round(r.objective, 6)) for r in df.collect())
    kept = order(siting.depot_network(rows, "area", per_depot=800.0))
    assert kept == order(siting.depot_network(rows, "area", per_depot=800.0, whole=10)) and len(kept) > 6


def test_portfolio_against_enumeration():
    """Never above the bound, totals as the definition gives them, near the best of all subsets, and no single swap helps."""
    rng = np.random.default_rng(7)
    for _ in range(8):
        n, budget = 9, 7.0
        value, cost_ = rng.uniform(1, 9, n), rng.uniform(1, 3, n)
        o = rng.uniform(0, 0.4, (n, n)) * (rng.random((n, n)) < 0.5)
        o = (o + o.T) / 2
        np.fill_diagonal(o, 0)
        near = [(np.flatnonzero(o[j]), o[j][np.flatnonzero(o[j])]) for j in range(n)]
        worth = lambda c: float((value[list(c)] * np.exp(-o[np.ix_(list(c), list(c))].sum(axis=1))).sum()) if len(c) else 0.0  # noqa: B023, E731
        chosen, total = siting.portfolio(value, cost_, near, budget)
        assert cost_[chosen].sum() <= budget + 1e-9 and abs(total - worth(chosen)) < 1e-9
        assert total <= siting.portfolio_bound(value, cost_, budget) + 1e-9
        best = max(worth(c) for k in range(n + 1) for c in itertools.combinations(range(n), k) if cost_[list(c)].sum() <= budget)
        assert total > 0.9 * best
        for i in chosen:
            for j in set(range(n)) - set(chosen):
                swap = sorted({*chosen, j} - {i})
                assert cost_[swap].sum() > budget or worth(swap) <= total + 1e-8


def test_running_sums_by_ranges(spark):
    from gridfold.operators.prefix import running

    rng = np.random.default_rng(4)
    rows = [(k, float(v), None if k % 9 == 0 else int(k % 5)) for k, v in enumerate(rng.integers(0, 40, 300))]
    got = {r.k: (r["rank"], r.running_n) for r in running(spark.createDataFrame(rows, "k long, v double, n long").repartition(5), [F.desc("v"), "k"], ["n"]).collect()}
    total = 0
    for place, (k, _, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += n or 0
        assert got[k] == (place, total)
    assert running(spark.createDataFrame([], "k long, n long"), ["k"], ["n"]).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    u = siting.uniform_of(F.col("id"), "speed", 3)
    a = spark.range(500).repartition(1).select("id", u.alias("u"), siting.triangular(u, 1.0, 2.0, 4.0).alias("t")).orderBy("id").collect()
    b = spark.range(500).repartition(7).select("id", u.alias("u"), siting.triangular(u, 1.0, 2.0, 4.0).alias("t")).orderBy("id").collect()
    assert a == b and abs(np.mean([r.t for r in a]) - 7 / 3) < 0.15 and all(0 < r.u < 1 for r in a)


def test_allocate(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 1.0), (3, 1.0), (4, 0.0)], "k int, s double")
    got = {r.k: r.p for r in allocate.allocate(df, "k", "s", 2.0).collect()}
    assert got[1] == pytest.approx(1, abs=1e-8) and got[2] == pytest.approx(0.5) and got[4] == pytest.approx(0, abs=1e-8)


def test_point_in_polygon(spark):
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    poly = spark.createDataFrame([("star", star)], "name string, vertices array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 0.5, 3.0), (4, 9.0, 9.0)], "p int, lon double, lat double")
    assert sorted(r.p for r in geo.in_polygons(pts, poly, "p", "name").collect()) == [1, 3]


def test_splits_are_whole_and_exact(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("unit"))
    exact = resample.split_exact(df, "unit", {"train": 0.6, "calibrate": 0.2, "test": 0.2}, seed=2)
    assert {r.split: r.n for r in exact.groupBy("split").agg(F.count_distinct("unit").alias("n")).collect()} == {"train": 60, "calibrate": 20, "test": 20}
    loose = resample.split(df, "unit", {"a": 0.5, "b": 0.5})
    assert loose.groupBy("unit").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_zone_merge_keeps_utilities(spark):
    df = spark.createDataFrame([(1, j, j == 2, float(j + 1)) for j in range(5)], "d long, alt long, chosen boolean, a double")
    got = resample.merge_zones(df, "d", "alt", "chosen", ["a"])
    assert sorted((r.alt, r.chosen, r.a) for r in got.collect()) == [(0, False, 3.0), (1, True, 7.0), (2, False, 5.0)]


def test_gates_and_audit(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int")
    got = {r.k: r.rejected_by for r in linkage.gate(rows, [("known", F.col("v").isNotNull()), ("small", F.col("v") < 10)]).collect()}
    assert got == {1: None, 2: "known", 3: "small"}
    r = _links(spark, [(1, "100 MAIN ST", "X", "CA", "90001", ""), (2, "100 MAIN STREET", "X", "CA", "90001", "")])
    audit = linkage.blocking_audit(r).first()
    assert (audit.matches, audit.generated) == (1, 1)


def test_fields(spark):
    df = spark.createDataFrame([("opened Sept 2019, expanded March 2021",), ("Q3 2018",), ("2017",), ("soon",)], "t string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in fields.text_date(F.col("t")).items()]).collect()]
    assert got == [(2021, 9, 3, "month"), (2018, None, 3, "quarter"), (2017, None, None, "year"), (None, None, None, "none")]
    row = spark.range(1).select(fields.floor_area(F.lit("1,020,000 sq ft")).alias("a"), fields.floor_area(F.lit("1.2 million")).alias("b"), fields.facility_code(F.lit("site BFI4 ")).alias("c"), fields.repaired_state(F.lit("0H"), ["OH", "IL"]).alias("d")).first()
    assert tuple(row) == (1020000.0, 1200000.0, "BFI4", "OH")
    cells = spark.createDataFrame([(0, "BFI4"), (0, "DWS4"), (1, "855,000"), (2, "WA"), (2, "OH")], "column int, text string")
    assert fields.identify_columns(cells) == {"code": 0, "sqft": 1, "state": 2}
