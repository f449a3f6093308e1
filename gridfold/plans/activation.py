"""Activation portfolios: net present value, break-even margins, their bound, and the frontier over margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions.columns import RADIUS_COST
from gridfold.operators import siting
from gridfold.plans.registry import query
from gridfold.plans.stand_ins import SITES, sites

#: Sites to activate, miles within which they take each other's parcels, margins per parcel of the frontier.
CAPACITY, REACH, MARGINS = 12, 18.6, (2.0, 3.0, 4.0, 6.0)
TERMS = siting.Activation()


def _candidates(spark, sf_dir) -> DataFrame:
    """Yearly parcels, cost and the line-haul part of it, per site."""
    k = F.col("site")
    return sites(spark, sf_dir).select("site", "site_lat", "site_lon", (F.col("mass") * 900).alias("parcels"), (F.col("mass") * 900 * (1.2 + k % 9 * 0.1)).alias("cost"), (F.col("mass") * 90 * (1 + k % 4)).alias("linehaul"))


@query()
def portfolio_frontier(spark, sf_dir):
    """At each margin the sites worth activating, their net present value, and the break-even margin against its bound. The driver holds the site table."""
    s = _candidates(spark, sf_dir)
    a, b = (F.col("parcels") * TERMS.annuity).alias("a"), ((F.col("cost") - F.col("linehaul") * TERMS.shared) * TERMS.annuity + TERMS.capital).alias("b")
    bound = siting.ratio_bound(s.select(a, b), "a", "b", CAPACITY)
    s = s.orderBy("site").toPandas()
    # 1 at no distance, 0 at the reach
    overlap = siting.Within(s.site_lat.to_numpy(), s.site_lon.to_numpy(), REACH, lambda miles: 1 - miles / REACH, RADIUS_COST)
    parcels, cost, linehaul = (s[c].to_numpy(float) for c in ("parcels", "cost", "linehaul"))
    out = []
    for margin in MARGINS:
        chosen, npv = siting.activate(parcels, cost, linehaul, overlap, CAPACITY, margin, TERMS)
        v = siting.activation_value(parcels, cost, linehaul, overlap, chosen, TERMS)
        out.append((margin, v["n"], npv, v["capital"], v["breakeven"], bound, v["breakeven"] / bound - 1, [int(s.site[j]) for j in chosen]))
    return spark.createDataFrame(out, "margin double, n int, npv double, capital double, breakeven double, bound double, gap double, sites array<long>")


def _steps(n: int) -> str:
    """Dinkelbach's iteration unrolled in SQL: r0 by the rows' own ratios, then by b - ratio * a."""
    out = [f"r0 AS (SELECT sum(b) / sum(a) AS r FROM (SELECT a, b FROM c ORDER BY b / a, a, b LIMIT {CAPACITY}))"]
    out += [f"r{k} AS (SELECT sum(b) / sum(a) AS r FROM (SELECT a, b FROM c, r{k - 1} ORDER BY b - r * a, a, b LIMIT {CAPACITY}))" for k in range(1, n + 1)]
    return ", ".join(out)


@query(f"""WITH {SITES}, c AS (SELECT mass * 900 * {TERMS.annuity!r}::DOUBLE AS a, (mass * 900 * (1.2::DOUBLE + site % 9 * 0.1::DOUBLE) - mass * 90 * (1 + site % 4) * {TERMS.shared}::DOUBLE) * {TERMS.annuity!r}::DOUBLE + {TERMS.capital}::DOUBLE AS b FROM sites), {_steps(8)}
  SELECT {CAPACITY}::BIGINT AS capacity, round(r, 6) AS bound FROM r8""")
def breakeven_bound(spark, sf_dir):
    """No portfolio of that size breaks even at a lower margin: savings in full, no parcels lost."""
    s = _candidates(spark, sf_dir)
    rows = s.select((F.col("parcels") * TERMS.annuity).alias("a"), ((F.col("cost") - F.col("linehaul") * TERMS.shared) * TERMS.annuity + TERMS.capital).alias("b"))
    return spark.createDataFrame([(CAPACITY, round(siting.ratio_bound(rows, "a", "b", CAPACITY), 6))], "capacity long, bound double")
