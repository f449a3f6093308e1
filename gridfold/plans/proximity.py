"""Proximity, cost and coverage queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridfold.functions import columns as C
from gridfold.functions.ordered import smallest_mode
from gridfold.operators import geo
from gridfold.operators.cost import BASELINE, SCENARIOS, CostParameters, evaluate, sweep
from gridfold.operators.prefix import running
from gridfold.plans.panel import dim_quarter_of
from gridfold.plans.registry import query
from gridfold.plans.stand_ins import PLACES, SITES, miles_sql, places, sites

MILES = miles_sql("lat", "lon", "site_lat", "site_lon", C.RADIUS_COST)
PAIRS = f"pairs AS (SELECT * FROM (SELECT p.*, s.*, {MILES} AS miles FROM places p, sites s))"
BASE = f"WITH {PLACES}, {SITES}, {PAIRS}"
NEAREST = "nearest AS (SELECT place, arg_min(site, (miles, site)) AS site, min(miles) AS miles FROM pairs GROUP BY place)"


@query(f"{BASE} SELECT place, site, round(miles, 6) AS miles FROM pairs WHERE miles <= 15")
def radius_pairs(spark, sf_dir):
    """Grid cells, then the exact distance."""
    return geo.radius_join(places(spark, sf_dir).select("place", "lat", "lon"), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), 15.0).select("place", "site", F.round("miles", 6).alias("miles"))


@query(f"{BASE}, {NEAREST} SELECT place, site, round(miles, 6) AS miles FROM nearest")
def nearest_site(spark, sf_dir):
    """Ties go to the smaller site."""
    out = geo.nearest(places(spark, sf_dir).select("place", "lat", "lon"), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), "site")
    return out.select("place", "site", F.round("miles", 6).alias("miles"))


@query(f"{BASE} SELECT place, arg_min(site, (miles, site)) AS site, round(min(miles), 6) AS miles FROM pairs WHERE county_id <> site_county_id GROUP BY place")
def nearest_site_excl_own(spark, sf_dir):
    """Leave-one-out by the place's own county."""
    left = places(spark, sf_dir).select("place", "county_id", "lat", "lon")
    out = geo.nearest(left, sites(spark, sf_dir).select("site", "site_county_id", "site_lat", "site_lon"), "site", other=F.col("county_id") != F.col("site_county_id"), same=("county_id",))
    return out.filter("site IS NOT NULL").select("place", "site", F.round("miles", 6).alias("miles"))


@query(f"WITH {SITES} SELECT a.site AS place, round(min({miles_sql('a.site_lat', 'a.site_lon', 'b.site_lat', 'b.site_lon', C.RADIUS_METRO)}), 6) AS miles FROM sites a JOIN sites b ON a.site_county_id <> b.site_county_id GROUP BY a.site")
def nearest_other_group(spark, sf_dir):
    """The nearest site of another county."""
    s = sites(spark, sf_dir)
    left = s.select(F.col("site").alias("place"), F.col("site_county_id").alias("county_id"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    out = geo.nearest(left, s.select("site", "site_county_id", "site_lat", "site_lon"), "site", other=F.col("county_id") != F.col("site_county_id"), same=("county_id",), radius=C.RADIUS_METRO)
    return out.filter("site IS NOT NULL").select("place", F.round("miles", 6).alias("miles"))


@query(f"WITH {PLACES} SELECT a.place, count(*) AS neighbours, round(sum(b.households), 2) AS households_near FROM places a, places b WHERE {miles_sql('a.lat', 'a.lon', 'b.lat', 'b.lon', C.RADIUS_COST)} <= 8 GROUP BY a.place")
def neighbour_sum(spark, sf_dir):
    """Sums over a radius self-join."""
    out = geo.neighbour_sums(places(spark, sf_dir).select("place", "lat", "lon", "households"), "place", 8.0, ["households"])
    return out.withColumn("households_near", F.round("households_near", 2))


@query(f"""{BASE}, {NEAREST}, r AS (SELECT unnest([2.0, 5.0, 10.0, 20.0, 40.0])::DOUBLE AS radius)
  SELECT radius, county_id, count(*) FILTER (WHERE miles <= radius) AS covered, count(*) FILTER (WHERE miles > radius) AS uncovered, round(coalesce(sum(households) FILTER (WHERE miles <= radius), 0), 1) AS covered_households, bool_and(miles <= radius) AS fully_covered FROM nearest JOIN places USING (place), r GROUP BY ALL""")
def coverage_by_radius(spark, sf_dir):
    """A sweep of radii over one nearest-site pass."""
    near = geo.nearest(places(spark, sf_dir).select("place", "county_id", "households", "lat", "lon"), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), "site")
    rows = near.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in (2.0, 5.0, 10.0, 20.0, 40.0)])))
    inside = F.col("miles") <= F.col("radius")
    return rows.groupBy("radius", "county_id").agg(F.count_if(inside).alias("covered"), F.count_if(~inside).alias("uncovered"), F.round(F.coalesce(F.sum(F.when(inside, F.col("households"))), F.lit(0.0)), 1).alias("covered_households"), F.bool_and(inside).alias("fully_covered"))


@query(f"{BASE}, {NEAREST} SELECT county_id, round(coalesce(sum(households) FILTER (WHERE miles > 5), 0), 1) AS uncovered_households, round(coalesce(sum(households) FILTER (WHERE miles > 5), 0) / sum(households), 6) AS share FROM nearest JOIN places USING (place) GROUP BY county_id")
def uncovered_by_group(spark, sf_dir):
    """A16."""
    near = geo.nearest(places(spark, sf_dir).select("place", "county_id", "households", "lat", "lon"), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), "site")
    gap = F.coalesce(F.sum(F.when(F.col("miles") > 5, F.col("households"))), F.lit(0.0))
    return near.groupBy("county_id").agg(F.round(gap, 1).alias("uncovered_households"), F.round(gap / F.sum("households"), 6).alias("share"))


@query(f"{BASE}, {NEAREST} SELECT place, households, round(miles, 6) AS miles FROM nearest JOIN places USING (place) WHERE miles > 5 ORDER BY households DESC, place LIMIT 25")
def top_uncovered(spark, sf_dir):
    """K2."""
    near = geo.nearest(places(spark, sf_dir).select("place", "households", "lat", "lon"), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), "site")
    return near.filter("miles > 5").orderBy(F.desc("households"), "place").limit(25).select("place", "households", F.round("miles", 6).alias("miles"))


@query(f"""{BASE}, old AS (SELECT place, min(miles) FILTER (WHERE open_year < 2019) AS miles FROM pairs GROUP BY place), hit AS (SELECT DISTINCT place FROM pairs WHERE open_year >= 2019 AND miles <= 3),
  r AS (SELECT place, county_id, h.place IS NOT NULL AS opened, row_number() OVER (ORDER BY households DESC, o.place) AS by_size, row_number() OVER (ORDER BY o.miles DESC NULLS FIRST, o.place) AS by_gap FROM old o JOIN places USING (place) LEFT JOIN hit h USING (place)),
  n AS (SELECT unnest([25, 100, 400]) AS n)
  SELECT n::BIGINT AS n, count(*) FILTER (WHERE opened AND by_size <= n) AS size_hits, count(*) FILTER (WHERE opened AND by_gap <= n) AS gap_hits, count(*) FILTER (WHERE opened AND by_size <= n AND by_gap > n) AS only_size, count(*) FILTER (WHERE opened AND by_gap <= n AND by_size > n) AS only_gap, count(DISTINCT county_id) FILTER (WHERE by_size <= n) AS size_counties FROM r, n GROUP BY n""")
def white_space_backtest(spark, sf_dir):
    """Two rules raced at a cut year; hits and the discordant counts of a paired test."""
    p, s = places(spark, sf_dir).select("place", "county_id", "households", "lat", "lon"), sites(spark, sf_dir)
    old = geo.nearest(p, s.filter("open_year < 2019").select("site", "site_lat", "site_lon"), "site")
    hit = geo.radius_join(p.select("place", "lat", "lon"), s.filter("open_year >= 2019").select("site_lat", "site_lon"), 3.0).select("place").distinct().withColumn("opened", F.lit(True))
    # only the first 400 of each rule are asked for: two top lists, and ranks within them
    seen = old.join(hit, "place", "left").withColumn("opened", F.coalesce("opened", F.lit(False)))
    top = lambda name, *order: seen.orderBy(*order).limit(400).withColumn(name, F.row_number().over(Window.orderBy(*order))).select("place", "county_id", "opened", name)
    r = top("by_size", F.desc("households"), "place").join(top("by_gap", F.desc_nulls_first("miles"), "place"), ["place", "county_id", "opened"], "full")
    r = r.fillna(1 << 30, ["by_size", "by_gap"])
    n = F.col("n")
    a, b = F.col("opened") & (F.col("by_size") <= n), F.col("opened") & (F.col("by_gap") <= n)
    return r.withColumn("n", F.explode(F.array(*[F.lit(k).cast("long") for k in (25, 100, 400)]))).groupBy("n").agg(F.count_if(a).alias("size_hits"), F.count_if(b).alias("gap_hits"), F.count_if(a & ~b).alias("only_size"), F.count_if(b & ~a).alias("only_gap"), F.count_distinct(F.when(F.col("by_size") <= n, F.col("county_id"))).alias("size_counties"))


@query(f"""{BASE}, v AS (SELECT unnest(range(2016, 2023)) AS vintage) SELECT county_id, vintage, round(min(miles) FILTER (WHERE kind = 'SC'), 6) AS nearest_sc, round(min(miles) FILTER (WHERE kind = 'FC'), 6) AS nearest_fc, count(DISTINCT site) FILTER (WHERE miles <= 50) AS within_50
  FROM pairs, v WHERE open_year <= vintage GROUP BY ALL""")
def network_vintages(spark, sf_dir):
    """The network as of each year, seen from all places of a county."""
    points = places(spark, sf_dir).select("county_id", "lat", "lon").distinct()
    at = sites(spark, sf_dir).select("site_lat", "site_lon").distinct()
    # how near each county comes to each point of sites; the sites there follow by a join
    near = geo.all_pairs(points, at).groupBy("county_id", "site_lat", "site_lon").agg(F.min("miles").alias("miles"))
    pairs = near.join(sites(spark, sf_dir), ["site_lat", "site_lon"])
    rows = pairs.withColumn("vintage", F.explode(F.sequence(F.greatest(F.lit(2016).cast("long"), "open_year"), F.lit(2022).cast("long"))))
    kind = lambda k: F.round(F.min(F.when(F.col("kind") == k, F.col("miles"))), 6)
    return rows.groupBy("county_id", "vintage").agg(kind("SC").alias("nearest_sc"), kind("FC").alias("nearest_fc"), F.count_distinct(F.when(F.col("miles") <= 50, F.col("site"))).alias("within_50"))


@query(f"{BASE} SELECT place, " + ", ".join(f"round(sum(CASE WHEN kind = '{k}' THEN {m} / pow(1 + miles, {a}) ELSE 0 END), 6) AS {k.lower()}_{n}_{str(a).replace('.', '')}" for k in ("FC", "SC") for n, m in (("count", "1"), ("mass", "mass")) for a in (0.5, 1.0, 2.0)) + " FROM pairs GROUP BY place")
def gravity_terms(spark, sf_dir):
    """C21 F13."""
    p = places(spark, sf_dir).groupBy("place", "lat", "lon").agg(F.count("*").alias("times"))
    # terms depend on the two points alone: places of one point share them, and sites of one point and kind count together
    at = sites(spark, sf_dir).filter(F.col("kind").isin("FC", "SC")).groupBy("site_lat", "site_lon", "kind").agg(F.count("*").alias("sites"), F.sum("mass").alias("mass"))
    # every place gets a row, also without sites of these kinds
    any_site = sites(spark, sf_dir).select("site_lat", "site_lon").limit(1).withColumns({"kind": F.lit("DS"), "sites": F.lit(0).cast("long"), "mass": F.lit(0.0)})
    pairs = geo.all_pairs(p.select("lat", "lon").distinct(), at.unionByName(any_site.select(at.columns)))
    terms = [F.sum(F.when(F.col("kind") == k, F.col(m) * C.inverse_decay("miles", a)).otherwise(0.0)).alias(f"{k.lower()}_{n}_{str(a).replace('.', '')}") for k in ("FC", "SC") for n, m in (("count", "sites"), ("mass", "mass")) for a in (0.5, 1.0, 2.0)]
    sums = pairs.groupBy(F.col("lat").alias("y"), F.col("lon").alias("x")).agg(*terms)
    return p.join(sums, F.col("lat").eqNullSafe(F.col("y")) & F.col("lon").eqNullSafe(F.col("x"))).select("place", *[F.round(F.col("times") * F.col(c), 6).alias(c) for c in sums.columns[2:]])


@query(f"""{BASE}, {NEAREST}, c AS (SELECT place, county_id, households, lat, lon, least(miles, 40) AS cur FROM nearest JOIN places USING (place))
  SELECT j.place, round(sum(i.households * greatest(0, i.cur - {miles_sql('i.lat', 'i.lon', 'j.lat', 'j.lon', C.RADIUS_COST)})), 4) AS saving FROM c i JOIN c j ON i.county_id = j.county_id GROUP BY j.place""")
def linehaul_saving(spark, sf_dir):
    """What a site at each candidate would save its county."""
    near = geo.nearest(places(spark, sf_dir).select("place", "county_id", "households", "lat", "lon"), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), "site")
    c = near.withColumn("cur", F.least("miles", F.lit(40.0))).select("place", "county_id", "households", "lat", "lon", "cur")
    j = c.select(F.col("place").alias("candidate"), "county_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    # beyond 40 miles nothing is saved, so pairs within them are enough
    gain = F.col("households") * F.greatest(F.lit(0.0), F.col("cur") - F.col("miles"))
    saved = geo.radius_join(c, j, 40.0, on=("county_id",)).groupBy(F.col("candidate").alias("place")).agg(F.sum(gain).alias("saving"))
    return c.select("place").join(saved, "place", "left").select("place", F.round(F.coalesce("saving", F.lit(0.0)), 4).alias("saving"))


OPEN_Q = "open_year * 4 + coalesce(open_quarter, 1) - 1"
CLOSE_Q = "CASE WHEN close_year IS NULL THEN 99999 ELSE close_year * 4 + coalesce(close_quarter, 4) - 1 END"
ENABLED = f"""q AS (SELECT y AS year, k AS quarter, y * 4 + k - 1 AS q_index FROM (SELECT unnest(range(2015, 2024)) AS y), (SELECT unnest(range(1, 5)) AS k)),
  f AS (SELECT place, {OPEN_Q} AS o, {CLOSE_Q} AS c, open_quarter IS NULL AS imputed FROM pairs WHERE miles <= 6),
  e AS (SELECT place, min(o) AS first_open, max(c) AS last_close FROM f GROUP BY place), i AS (SELECT f.place, bool_or(imputed) AS imputed FROM f JOIN e ON f.place = e.place AND f.o = e.first_open GROUP BY f.place)"""


@query(f"{BASE}, {ENABLED} SELECT p.place, q.year, q.quarter, coalesce(q.q_index BETWEEN first_open AND last_close, false) AS enabled, coalesce(i.imputed, false) AS open_quarter_imputed FROM places p CROSS JOIN q LEFT JOIN e ON e.place = p.place LEFT JOIN i ON i.place = p.place")
def catchment_enabled(spark, sf_dir):
    """A place is enabled from the first opening to the last closing in its catchment, gaps included."""
    s = sites(spark, sf_dir).withColumns({"o": C.quarter_index("open_year", F.coalesce("open_quarter", F.lit(1))), "c": F.coalesce(C.quarter_index("close_year", F.coalesce("close_quarter", F.lit(4))), F.lit(99999)), "imputed": F.col("open_quarter").isNull()})
    p = places(spark, sf_dir).select("place", "lat", "lon")
    f = geo.radius_join(p, s.select("site_lat", "site_lon", "o", "c", "imputed"), 6.0)
    span = f.groupBy("place").agg(F.min("o").alias("first_open"), F.max("c").alias("last_close"), F.min_by(F.struct("imputed"), F.struct("o", F.when(F.col("imputed"), 0).otherwise(1))).alias("set_by"))
    grid = p.select("place").crossJoin(F.broadcast(dim_quarter_of(spark, 2015, 2023)))
    out = grid.join(span, "place", "left")
    return out.select("place", "year", "quarter", F.coalesce(F.col("q_index").between(F.col("first_open"), F.col("last_close")), F.lit(False)).alias("enabled"), F.coalesce("set_by.imputed", F.lit(False)).alias("open_quarter_imputed"))


def _cost_sql(name: str, p: CostParameters = BASELINE) -> str:
    """Common tables of the cost decomposition, ending in one of the given name."""
    return f"""{name}_a AS (SELECT place, county_id, segment, site, households, income IS NULL AS income_imputed, land, wage, diesel, households * {p.parcels_per_household_per_week} * pow(coalesce(income, {p.reference_income_usd}) / {p.reference_income_usd}, {p.income_elasticity}) / {p.delivery_days_per_week} AS daily_parcels, coalesce(miles * {p.circuity}, {p.default_linehaul_miles}) AS linehaul_miles FROM places JOIN nearest USING (place)),
  {name}_b AS (SELECT *, daily_parcels / {p.parcels_per_stop} AS daily_stops, wage * {p.wage_loading} / ({p.shift_hours} * {p.delivery_days_per_week} * 52.0) AS hourly FROM {name}_a),
  {name}_c AS (SELECT *, CASE WHEN land > 0 AND daily_stops > 0 THEN daily_stops / land END AS stop_density, {p.bhh_constant} / sqrt(CASE WHEN land > 0 AND daily_stops > 0 THEN daily_stops / land END) * {p.circuity} + 2.0 * linehaul_miles / {p.stops_per_tour} AS miles_per_stop FROM {name}_b),
  {name}_d AS (SELECT *, miles_per_stop * (diesel / {p.van_mpg} + {p.maintenance_usd_per_mile}) AS cost_distance, miles_per_stop / {p.avg_speed_mph} * hourly AS cost_drive_time, {p.service_minutes_per_stop} / 60.0 * hourly AS cost_service_time, {p.van_lease_usd_per_day} / {p.stops_per_tour}::DOUBLE AS cost_vehicle FROM {name}_c),
  {name} AS (SELECT *, cost_distance + cost_drive_time + cost_service_time + cost_vehicle AS cost_per_stop, (cost_distance + cost_drive_time + cost_service_time + cost_vehicle) / {p.parcels_per_stop} AS cost_per_parcel, daily_stops / {p.stops_per_tour} AS van_days FROM {name}_d)"""


def costs(spark, sf_dir, p: CostParameters = BASELINE):
    near = geo.nearest(places(spark, sf_dir), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), "site")
    return evaluate(near.withColumnRenamed("miles", "linehaul"), p)


COST = f"{BASE}, {NEAREST}, {_cost_sql('cost')}"


@query(f"{COST} SELECT place, round(daily_parcels, 6) AS daily_parcels, round(stop_density, 6) AS stop_density, round(cost_distance, 6) AS cost_distance, round(cost_drive_time, 6) AS cost_drive_time, round(cost_service_time, 6) AS cost_service_time, round(cost_per_parcel, 6) AS cost_per_parcel, round(van_days, 6) AS van_days, income_imputed FROM cost")
def cost_to_serve(spark, sf_dir):
    """C1 C2 C3 C4 C7 C8 S20 S22."""
    r = lambda c: F.round(c, 6).alias(c)
    return costs(spark, sf_dir).select("place", *[r(c) for c in ("daily_parcels", "stop_density", "cost_distance", "cost_drive_time", "cost_service_time", "cost_per_parcel", "van_days")], "income_imputed")


@query(f"{BASE}, {NEAREST}, " + ", ".join(_cost_sql(k, p) for k, p in SCENARIOS.items()) + ", m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scenario, quantile_cont(cost_per_parcel, 0.5) AS med, sum(cost_per_stop * daily_stops) AS daily_cost FROM {k}" for k in SCENARIOS) + ") SELECT scenario, round(med, 6) AS median_cost, round(daily_cost, 2) AS daily_cost, round(med / (SELECT med FROM m WHERE scenario = 'baseline'), 6) AS to_baseline FROM m")
def cost_scenarios(spark, sf_dir):
    """The scenario sweep against the baseline."""
    near = geo.nearest(places(spark, sf_dir), sites(spark, sf_dir).select("site", "site_lat", "site_lon"), "site").withColumnRenamed("miles", "linehaul")
    m = sweep(near, SCENARIOS).groupBy("scenario").agg(F.median("cost_per_parcel").alias("med"), F.sum("daily_cost").alias("daily_cost"))
    base = F.max(F.when(F.col("scenario") == "baseline", F.col("med"))).over(Window.partitionBy(F.lit(1)))
    return m.withColumn("base", base).select("scenario", F.round("med", 6).alias("median_cost"), F.round("daily_cost", 2).alias("daily_cost"), F.round(F.col("med") / F.col("base"), 6).alias("to_baseline"))


@query(f"""{COST}, mode AS (SELECT site, arg_min(segment, (-n, segment)) AS modal_segment FROM (SELECT site, segment, count(*) AS n FROM cost GROUP BY ALL) GROUP BY site)
  SELECT site, count(*) AS places, round(quantile_cont(cost_per_parcel, 0.5), 6) AS median_cost, round(quantile_cont(cost_per_parcel, 0.25), 6) AS q1, round(quantile_cont(cost_per_parcel, 0.75), 6) AS q3, round(sum(daily_parcels), 4) AS parcels, round(sum(cost_per_stop * daily_stops) / sum(daily_parcels) FILTER (WHERE cost_per_stop IS NOT NULL), 6) AS pooled, any_value(modal_segment) AS modal_segment FROM cost JOIN mode USING (site) GROUP BY site""")
def station_rollup(spark, sf_dir):
    """A row per station."""
    c = costs(spark, sf_dir)
    modal = smallest_mode(c, ["site"], "segment", "modal_segment")
    q = F.percentile("cost_per_parcel", [0.25, 0.5, 0.75])
    by = c.groupBy("site").agg(F.count("*").alias("places"), q.alias("q"), F.round(F.sum("daily_parcels"), 4).alias("parcels"), F.round(F.sum("daily_cost") / F.sum(F.when(F.col("cost_per_stop").isNotNull(), F.col("daily_parcels"))), 6).alias("pooled"))
    return by.join(modal, "site").select("site", "places", F.round(F.col("q")[1], 6).alias("median_cost"), F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[2], 6).alias("q3"), "parcels", "pooled", "modal_segment")


@query(f"""{COST}, c AS (SELECT * FROM cost WHERE cost_per_stop IS NOT NULL) SELECT CASE WHEN grouping(segment) = 1 THEN 'ALL' ELSE segment END AS segment, round(sum(cost_distance * daily_stops) / sum(cost_per_stop * daily_stops), 6) AS distance_share, round(sum(cost_service_time * daily_stops) / sum(cost_per_stop * daily_stops), 6) AS service_share, round(sum(cost_per_stop * daily_stops) / sum(daily_stops), 6) AS per_stop FROM c GROUP BY ROLLUP (segment)""")
def cost_decomposition(spark, sf_dir):
    """Stop-weighted shares, with the total row."""
    c = costs(spark, sf_dir).filter("cost_per_stop IS NOT NULL")
    total = F.sum(F.col("cost_per_stop") * F.col("daily_stops"))
    share = lambda k, n: F.round(F.sum(F.col(k) * F.col("daily_stops")) / total, 6).alias(n)
    out = c.rollup("segment").agg(F.grouping("segment").alias("g"), share("cost_distance", "distance_share"), share("cost_service_time", "service_share"), F.round(total / F.sum("daily_stops"), 6).alias("per_stop"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("segment")).alias("segment"), "distance_share", "service_share", "per_stop")


@query(f"""{COST} SELECT count(*) AS places, round(quantile_cont(cost_per_parcel, 0.5), 6) AS median_cost, round(avg(CASE WHEN cost_per_parcel < 1.2 THEN 1.0 ELSE 0.0 END), 6) AS share_under, round(sum(daily_parcels) FILTER (WHERE cost_per_parcel < 1.2) / sum(daily_parcels), 6) AS parcel_share, ceil(sum(van_days))::BIGINT AS vans, sum(ceil(van_days))::BIGINT AS dedicated_vans, count(*) FILTER (WHERE van_days < 1) AS below_a_tour, round(sum(households) FILTER (WHERE van_days < 1) / sum(households), 6) AS household_share_below FROM cost""")
def kpis(spark, sf_dir):
    """Tiles and floors; vans are rounded up once."""
    low = F.col("cost_per_parcel") < 1.2
    return costs(spark, sf_dir).agg(F.count("*").alias("places"), F.round(F.median("cost_per_parcel"), 6).alias("median_cost"), F.round(F.avg(F.when(low, 1.0).otherwise(0.0)), 6).alias("share_under"), F.round(F.sum(F.when(low, F.col("daily_parcels"))) / F.sum("daily_parcels"), 6).alias("parcel_share"), F.ceil(F.sum("van_days")).alias("vans"), F.sum(F.ceil("van_days")).alias("dedicated_vans"), F.count_if(F.col("van_days") < 1).alias("below_a_tour"), F.round(F.sum(F.when(F.col("van_days") < 1, F.col("households"))) / F.sum("households"), 6).alias("household_share_below"))


@query(f"""{COST}, c AS (SELECT * FROM cost WHERE cost_per_parcel IS NOT NULL), r AS (SELECT place, county_id, cost_per_parcel, (rank() OVER (PARTITION BY county_id ORDER BY cost_per_parcel) + (count(*) OVER (PARTITION BY county_id, cost_per_parcel) - 1) / 2.0) / count(*) OVER (PARTITION BY county_id) AS pct FROM c)
  SELECT county_id, count(*) FILTER (WHERE pct <= 0.1) AS cheapest, round(avg(cost_per_parcel) FILTER (WHERE pct <= 0.1), 6) AS cheap_mean, round(max(pct), 6) AS top, arg_min(place, (cost_per_parcel, place)) AS cheapest_place, arg_max(place, (cost_per_parcel, place)) AS dearest_place FROM r GROUP BY county_id""")
def cheapest_decile(spark, sf_dir):
    """Percentile ranks with ties averaged; cheapest and dearest members."""
    c = costs(spark, sf_dir).filter("cost_per_parcel IS NOT NULL").select("place", "county_id", "cost_per_parcel")
    r = c.withColumn("pct", C.percentile_rank(F.col("cost_per_parcel"), F.col("county_id")))
    low = F.col("pct") <= 0.1
    order = F.struct("cost_per_parcel", "place")
    return r.groupBy("county_id").agg(F.count_if(low).alias("cheapest"), F.round(F.avg(F.when(low, F.col("cost_per_parcel"))), 6).alias("cheap_mean"), F.round(F.max("pct"), 6).alias("top"), F.min_by("place", order).alias("cheapest_place"), F.max_by("place", order).alias("dearest_place"))


@query(f"""{COST}, c AS (SELECT * FROM cost WHERE cost_per_parcel IS NOT NULL) SELECT place, round(sum(daily_parcels) OVER (ORDER BY cost_per_parcel, place ROWS UNBOUNDED PRECEDING) / sum(daily_parcels) OVER (), 6) AS parcel_share, round(row_number() OVER (ORDER BY cost_per_parcel, place) / count(*) OVER ()::DOUBLE, 6) AS place_share FROM c""")
def cumulative_coverage(spark, sf_dir):
    """Cumulative shares by cost."""
    c = costs(spark, sf_dir).filter("cost_per_parcel IS NOT NULL").select("place", "cost_per_parcel", "daily_parcels")
    ranked = running(c, ["cost_per_parcel", "place"], ["daily_parcels"])
    total = c.agg(F.sum("daily_parcels").alias("all_parcels"), F.count("*").alias("all_places"))
    return ranked.crossJoin(F.broadcast(total)).select("place", F.round(F.col("running_daily_parcels") / F.col("all_parcels"), 6).alias("parcel_share"), F.round(F.col("rank") / F.col("all_places"), 6).alias("place_share"))


@query(f"{COST} SELECT place, round(cost_per_parcel, 6) AS cost_per_parcel FROM cost WHERE cost_per_parcel IS NOT NULL ORDER BY cost_per_parcel, place LIMIT 50")
def cheapest_places(spark, sf_dir):
    """K3 K8 W3 P19."""
    return costs(spark, sf_dir).filter("cost_per_parcel IS NOT NULL").orderBy("cost_per_parcel", "place").limit(50).select("place", F.round("cost_per_parcel", 6).alias("cost_per_parcel"))


CENTROIDS = "centroid AS (SELECT county_id AS site_county_id, avg(lat) AS centre_lat, avg(lon) AS centre_lon FROM places GROUP BY county_id)"


def centroids(spark, sf_dir):
    """The middle of each county's places."""
    return places(spark, sf_dir).groupBy(F.col("county_id").alias("site_county_id")).agg(F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"))


@query(f"""WITH {PLACES}, {SITES}, {CENTROIDS} SELECT site, round(CASE WHEN site % 3 <> 0 THEN site_lat ELSE centre_lat END, 4) AS lat, round(CASE WHEN site % 3 <> 0 THEN site_lon ELSE centre_lon END, 4) AS lon, CASE WHEN site % 3 <> 0 THEN 'geocoded' WHEN centre_lat IS NOT NULL THEN 'centroid' ELSE 'none' END AS source FROM sites LEFT JOIN centroid USING (site_county_id)""")
def resolve_coordinates(spark, sf_dir):
    """Geocoded coordinates (here for two of three sites), else the county's centroid; the source is kept."""
    known = F.col("site") % 3 != 0
    s = sites(spark, sf_dir).withColumns({"lat": F.when(known, F.col("site_lat")), "lon": F.when(known, F.col("site_lon"))})
    s = s.join(centroids(spark, sf_dir), "site_county_id", "left")
    source = F.when(F.col("lat").isNotNull(), "geocoded").when(F.col("centre_lat").isNotNull(), "centroid").otherwise("none")
    return s.select("site", F.round(F.coalesce("lat", "centre_lat"), 4).alias("lat"), F.round(F.coalesce("lon", "centre_lon"), 4).alias("lon"), source.alias("source"))


