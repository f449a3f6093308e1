"""Facility loading and merging, the whole place panel, and event, demand and conformal reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridfold.functions import columns as C
from gridfold.operators import facilities, linkage, metrics, resample
from gridfold.plans.panel import YEARS, _years, dense, dim_quarter_of, optional_block
from gridfold.plans.proximity import CENTROIDS, centroids
from gridfold.plans.registry import query
from gridfold.plans.stand_ins import PLACES, SITES, places, sites, table

# --- the panel -----------------------------------------------------------------------------------------------------


@query(f"""WITH {PLACES}, {SITES}, {YEARS},
  f AS (SELECT o_custkey AS place, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, sum(o_totalprice) AS revenue, count(*) AS n FROM orders GROUP BY ALL),
  yearly AS (SELECT place, year, sum(revenue) AS revenue_year FROM f GROUP BY ALL),
  o AS (SELECT county_id, metro, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, o_totalprice, o_orderpriority FROM orders JOIN places ON o_custkey = place),
  rent AS (SELECT county_id, year, quarter, avg(o_totalprice) AS rent FROM o GROUP BY ALL),
  permits AS (SELECT county_id, year, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS permits FROM o GROUP BY ALL),
  energy AS (SELECT metro, year, quarter, avg(o_totalprice) / 1000 AS energy FROM o WHERE metro IS NOT NULL GROUP BY ALL),
  block AS (SELECT county_id, year, avg(o_totalprice / 2) AS extra FROM o GROUP BY ALL),
  span AS (SELECT site_county_id AS county_id, open_year * 4 + coalesce(open_quarter, 1) - 1 AS a, coalesce(close_year * 4 + coalesce(close_quarter, 1) - 1, 2147483647) AS z FROM sites),
  open AS (SELECT county_id, year, quarter, count(*) AS facilities FROM span JOIN quarters ON year * 4 + quarter - 1 + 92 >= a AND year * 4 + quarter - 1 + 92 < z GROUP BY ALL)
  SELECT p.place, p.zcta, p.county_id, q.year, q.quarter, q.year::VARCHAR || 'Q' || q.quarter::VARCHAR AS date_id, p.households, p.income, round(f.revenue, 2) AS revenue, coalesce(f.n, 0) AS n_orders, round(b.revenue, 2) AS revenue_prior,
    round(CASE WHEN b.revenue > 0 THEN 100.0 * (f.revenue - b.revenue) / b.revenue END, 6) AS revenue_yoy_pct, round(y.revenue_year, 2) AS revenue_year, floor(r.rent * 100 + 1e-6) / 100 AS rent, m.permits, floor(e.energy * 10000 + 1e-6) / 10000 AS energy, floor(x.extra * 100 + 1e-6) / 100 AS extra, t.facilities
  FROM places p CROSS JOIN quarters q LEFT JOIN f ON f.place = p.place AND f.year = q.year AND f.quarter = q.quarter LEFT JOIN f b ON b.place = p.place AND b.year = q.year - 1 AND b.quarter = q.quarter
    LEFT JOIN yearly y ON y.place = p.place AND y.year = q.year LEFT JOIN rent r ON r.county_id = p.county_id AND r.year = q.year AND r.quarter = q.quarter LEFT JOIN permits m ON m.county_id = p.county_id AND m.year = q.year
    LEFT JOIN energy e ON e.metro = p.metro AND e.year = q.year AND e.quarter = q.quarter LEFT JOIN block x ON x.county_id = p.county_id AND x.year = q.year LEFT JOIN open t ON t.county_id = p.county_id AND t.year = q.year AND t.quarter = q.quarter""")
def place_panel(spark, sf_dir):
    """Place x quarter with revenue of the quarter and year, rent, permits, energy, an optional block and the facility target."""
    p = places(spark, sf_dir).select("place", "zcta", "county_id", "metro", "households", "income")
    quarters = dim_quarter_of(spark, *_years(spark, sf_dir))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter"), "o_totalprice", "o_orderpriority")
    facts = orders.groupBy("place", "year", "quarter").agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n_orders"))
    before = facts.select("place", (F.col("year") + 1).alias("year"), "quarter", F.col("revenue").alias("revenue_prior"))
    yearly = facts.groupBy("place", "year").agg(F.sum("revenue").alias("revenue_year"))
    placed = orders.join(p.select("place", "county_id", "metro"), "place")
    county = placed.groupBy("county_id", "year", "quarter").agg(F.avg("o_totalprice").alias("rent"))
    permits = placed.groupBy("county_id", "year").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("permits"))
    energy = placed.filter("metro IS NOT NULL").groupBy("metro", "year", "quarter").agg((F.avg("o_totalprice") / 1000).alias("energy"))
    extra = optional_block(placed.select("county_id", "year", (F.col("o_totalprice") / 2).alias("extra")), "county_id", ["rent"])
    span = sites(spark, sf_dir).select(F.col("site_county_id").alias("county_id"), C.quarter_index("open_year", F.coalesce("open_quarter", F.lit(1))).alias("a"), F.coalesce(C.quarter_index("close_year", F.coalesce("close_quarter", F.lit(1))), F.lit(facilities.NEVER)).alias("z"))
    at = F.col("q_index") + 92  # the sites open 23 years after the orders
    target = span.join(F.broadcast(quarters), (at >= F.col("a")) & (at < F.col("z"))).groupBy("county_id", "year", "quarter").agg(F.count("*").alias("facilities"))
    grid = dense(p, quarters).join(facts, ["place", "year", "quarter"], "left").join(before, ["place", "year", "quarter"], "left").join(yearly, ["place", "year"], "left")
    grid = grid.join(county, ["county_id", "year", "quarter"], "left").join(permits, ["county_id", "year"], "left").join(energy, ["metro", "year", "quarter"], "left").join(extra, ["county_id", "year"], "left").join(target, ["county_id", "year", "quarter"], "left")
    cut = lambda c, scale: F.floor(F.col(c) * scale + 1e-6) / scale  # noqa: E731  means cut, not rounded: sums in another order end alike
    return grid.select("place", "zcta", "county_id", "year", "quarter", "date_id", "households", "income", F.round("revenue", 2).alias("revenue"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round("revenue_prior", 2).alias("revenue_prior"), F.round(C.yoy("revenue", "revenue_prior"), 6).alias("revenue_yoy_pct"), F.round("revenue_year", 2).alias("revenue_year"), cut("rent", 100).alias("rent"), "permits", cut("energy", 10000).alias("energy"), cut("extra", 100).alias("extra"), "facilities")


# --- facilities ----------------------------------------------------------------------------------------------------

RAW = """raw AS (SELECT s_suppkey AS site, (s_suppkey % 900)::VARCHAR AS zip, CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' WHEN s_suppkey % 7 = 1 THEN '1,' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') ELSE (s_suppkey * 7 % 5000)::VARCHAR END AS sqft,
    CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' Open ' WHEN 2 THEN 'CLOSED' END AS status, CASE WHEN s_suppkey % 11 = 0 THEN 'soon' ELSE (2015 + s_suppkey % 8)::VARCHAR END AS open_year, CASE WHEN s_suppkey % 3 > 0 THEN (1 + s_suppkey % 4)::VARCHAR END AS open_quarter,
    CASE WHEN s_suppkey % 6 = 0 THEN (2019 + s_suppkey % 4)::VARCHAR END AS close_year, NULL::VARCHAR AS close_quarter, ['FC', 'SC', 'DS', 'XX'][s_suppkey % 4 + 1] AS kind FROM supplier),
  typed AS (SELECT site, lpad(zip, 5, '0') AS zip, try_cast(replace(sqft, ',', '') AS DOUBLE) AS sqft, coalesce(nullif(lower(trim(status)), ''), 'open') AS status, kind,
    try_cast(open_year AS INT) * 4 + coalesce(try_cast(open_quarter AS INT), 1) - 1 AS open_q, coalesce(try_cast(close_year AS INT) * 4 + coalesce(try_cast(close_quarter AS INT), 1) - 1, 2147483647) AS close_q FROM raw)"""


def raw_facilities(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    sqft = F.when(k % 7 == 0, "n/a").when(k % 7 == 1, F.concat(F.lit("1,"), F.lpad(text(k % 1000), 3, "0"))).otherwise(text(k * 7 % 5000))
    status = F.when(k % 4 == 0, "").when(k % 4 == 1, " Open ").when(k % 4 == 2, "CLOSED")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("FC", "SC", "DS", "XX")]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("site"), text(k % 900).alias("zip"), sqft.alias("sqft"), status.alias("status"), F.when(k % 11 == 0, "soon").otherwise(text(2015 + k % 8)).alias("open_year"),
        F.when(k % 3 > 0, text(1 + k % 4)).alias("open_quarter"), F.when(k % 6 == 0, text(2019 + k % 4)).alias("close_year"), F.lit(None).cast("string").alias("close_quarter"), kind.alias("kind"),
    )


@query(f"WITH {RAW} SELECT site, zip, sqft, status, open_q, close_q FROM typed")
def facility_load(spark, sf_dir):
    """Text fields typed; unknown openings stay null."""
    return facilities.typed(raw_facilities(spark, sf_dir), numbers=["sqft"]).select("site", "zip", "sqft", "status", F.col("open_q").cast("long").alias("open_q"), F.col("close_q").cast("long").alias("close_q"))


_NATIONAL = f"""{RAW}, known AS (SELECT *, coalesce(CASE kind WHEN 'FC' THEN 'fulfilment' WHEN 'SC' THEN 'sorting' WHEN 'DS' THEN 'delivery' END, 'other') AS category, (sqft IS NOT NULL)::INT + (open_q IS NOT NULL)::INT + (close_q <> 2147483647)::INT AS k FROM typed)"""


@query(f"""WITH {_NATIONAL} SELECT site, category, CASE WHEN open_q IS NULL THEN 'unknown' WHEN open_q > 8080 THEN 'planned' WHEN close_q <= 8080 THEN 'closed' ELSE 'operating' END AS operation,
  CASE WHEN k >= 2 THEN 'high' WHEN k = 1 THEN 'medium' ELSE 'low' END AS confidence, k >= 2 AND category <> 'other' AS vouched FROM known""")
def facility_national(spark, sf_dir):
    """One national shape with status, confidence and vouching."""
    rows = facilities.typed(raw_facilities(spark, sf_dir), numbers=["sqft"])
    return facilities.national(rows, {"FC": "fulfilment", "SC": "sorting", "DS": "delivery"}, 8080).select("site", "category", "operation", "confidence", "vouched")


@query(f"""WITH {PLACES}, {SITES}, {CENTROIDS}, {_NATIONAL} SELECT k.site, CASE WHEN open_q IS NULL OR sqft IS NULL THEN 'schema' WHEN abs(site_lat - centre_lat) > 1.5 THEN 'geocode' WHEN k < 2 OR category = 'other' THEN 'confidence' END AS rejected_by
  FROM known k JOIN sites s ON s.site = k.site LEFT JOIN centroid USING (site_county_id)""")
def mutation_gates(spark, sf_dir):
    """Ordered gates on typed facilities: fields present, coordinates near the county's centre, vouched for; the first that fails is named."""
    rows = facilities.national(facilities.typed(raw_facilities(spark, sf_dir), numbers=["sqft"]), {"FC": "fulfilment", "SC": "sorting", "DS": "delivery"}, 8080)
    where = sites(spark, sf_dir).select("site", "site_lat", "site_county_id").join(F.broadcast(centroids(spark, sf_dir)), "site_county_id", "left")
    rows = rows.join(where, "site")
    return linkage.gate(rows, [("schema", F.col("open_q").isNotNull() & F.col("sqft").isNotNull()), ("geocode", F.abs(F.col("site_lat") - F.col("centre_lat")) <= 1.5), ("confidence", F.col("vouched"))]).select("site", "rejected_by")


_MERGE = """r AS (SELECT s_suppkey AS site, s_suppkey % 40 AS code, s_suppkey % 25 AS city, s_suppkey % 3 = 0 AS fresh FROM supplier), n AS (SELECT * FROM r WHERE fresh), b AS (SELECT * FROM r WHERE NOT fresh AND code % 5 > 0),
  tw AS (SELECT x.site, min(y.site) AS twin FROM n x JOIN n y ON x.code = y.code AND x.city = y.city AND x.site > y.site GROUP BY x.site), ba AS (SELECT x.site, min(y.site) AS base FROM n x JOIN b y ON x.code = y.code AND x.city = y.city GROUP BY x.site),
  rv AS (SELECT DISTINCT x.site FROM n x JOIN b y ON x.city = y.city AND x.code % 20 = y.code % 20 AND x.code <> y.code),
  act AS (SELECT n.site, CASE WHEN twin IS NOT NULL THEN 'duplicate' WHEN base IS NOT NULL THEN 'merged' WHEN rv.site IS NOT NULL THEN 'held' ELSE 'appended' END AS action, coalesce(twin, base) AS "into" FROM n LEFT JOIN tw USING (site) LEFT JOIN ba USING (site) LEFT JOIN rv USING (site))"""


def _merged(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("site"), (k % 40).alias("code"), (k % 25).alias("city"))
    new, base = rows.filter("site % 3 = 0"), rows.filter("site % 3 <> 0 AND code % 5 > 0")
    side = lambda df, name: df.select(F.col("site").alias(name), F.col("code").alias(f"code_{name}"), "city", (F.col("code") % 20).alias("block"))
    call = F.when(F.col("code_a") == F.col("code_b"), "match").otherwise("review")
    pairs = lambda other: side(new, "a").join(side(other, "b"), ["city", "block"]).withColumn("call", call).select("a", "b", "call")
    return facilities.merge_source(new, pairs(new).filter("a > b AND call = 'match'"), pairs(base), "site")


@query(f"WITH {_MERGE} SELECT site, action, \"into\" FROM act")
def facility_merge(spark, sf_dir):
    """Twins within the new source, matches with the base, holds for review, appends."""
    return _merged(spark, sf_dir)


@query(f"WITH {_MERGE} SELECT action, count(*) AS n, round(count(*) / (SELECT count(*) FROM act)::DOUBLE, 8) AS share FROM act GROUP BY action")
def merge_report(spark, sf_dir):
    """What became of a new source."""
    return facilities.merge_report(_merged(spark, sf_dir)).withColumn("share", F.round("share", 8))


@query(f"WITH {_MERGE} SELECT site FROM act WHERE action = 'appended'")
def batch_select(spark, sf_dir):
    """The rows that a batch appends, once held ones are settled (here: left out)."""
    return facilities.batch_candidates(_merged(spark, sf_dir).filter("action <> 'held'"), "site")


@query("WITH n AS (SELECT DISTINCT substr(c_name, 1, 1) || 'x' AS none, substr(n_name, 1, 1 + c_custkey % 3) AS short FROM customer JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT short, count(DISTINCT n_name) AS k, min(n_name) AS region FROM n JOIN nation ON starts_with(n_name, short) GROUP BY short) SELECT short, CASE WHEN k = 1 THEN region END AS region FROM m")
def region_prefix(spark, sf_dir):
    """Shortened names that begin exactly one region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    names = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.substr("region", F.lit(1), (1 + F.col("c_custkey") % 3).cast("int")).alias("short"))
    return facilities.unambiguous_prefix(names, "short", nation, "region")


@query("SELECT * REPLACE (round(s_acctbal / 100, 2) AS s_acctbal, upper(s_name) AS s_name) FROM (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier)")
def replace_columns(spark, sf_dir):
    """P10: some columns replaced in place."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return facilities.replaced(s, s_acctbal=F.round(F.col("s_acctbal") / 100, 2), s_name=F.upper("s_name"))


@query(f"WITH {PLACES} SELECT place, metro, income FROM places WHERE metro IN ('ASIA', 'EUROPE', 'AMERICA') AND income IS NOT NULL")
def complete_cases(spark, sf_dir):
    """Rows of chosen metros without missing values."""
    chosen = spark.createDataFrame([("ASIA",), ("EUROPE",), ("AMERICA",)], "metro string")
    return places(spark, sf_dir).select("place", "metro", "income").join(F.broadcast(chosen), "metro", "left_semi").dropna()


@query(f"WITH {PLACES}, d AS (SELECT place, CASE WHEN land = 0 THEN 'inf'::DOUBLE ELSE score / land END AS density FROM places) SELECT place, round(log10(density), 8) AS log_density FROM d WHERE isfinite(density) AND density > 0")
def log_plot_rows(spark, sf_dir):
    """P20: infinite and non-positive values leave before a logarithm."""
    d = places(spark, sf_dir).select("place", F.when(F.col("land") == 0, F.lit(float("inf"))).otherwise(F.col("score") / F.nullif("land", F.lit(0.0))).alias("density"))
    return d.filter((F.col("density") < float("inf")) & (F.col("density") > 0)).select("place", F.round(F.log10("density"), 8).alias("log_density"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) SELECT c_custkey AS place, coalesce(o_orderkey, 0) AS first_order, coalesce(o_totalprice, 0) AS first_value FROM customer LEFT JOIN r ON o_custkey = c_custkey AND rk = 1")
def universe_rows(spark, sf_dir):
    """One row per place, its first record, nulls as 0."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("place")).agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("f"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place")).join(first, "place", "left").select("place", F.coalesce("f.o_orderkey", F.lit(0)).alias("first_order"), F.coalesce("f.o_totalprice", F.lit(0.0)).alias("first_value"))


# --- events --------------------------------------------------------------------------------------------------------

_RISK = """e AS (SELECT user_id, CAST(date_part('day', ts) AS BIGINT) AS t, bool_or(event_type = 'purchase') AS event, sum(value) AS load FROM events GROUP BY ALL), f AS (SELECT *, min(CASE WHEN event THEN t END) OVER (PARTITION BY user_id) AS first_event FROM e),
  risk AS (SELECT user_id, t, event, load FROM f WHERE t > 1 AND (first_event IS NULL OR (t <= first_event AND first_event > 1)))"""


def _risk(spark, sf_dir):
    from gridfold.operators.hazard import risk_set

    e = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("t")).agg(F.bool_or(F.col("event_type") == "purchase").alias("event"), F.sum("value").alias("load"))
    return risk_set(e, "user_id", "t", "event", first=1)


@query(f"WITH {_RISK}, g AS (SELECT t, user_id % 5 AS grp, event FROM risk) SELECT grp AS \"group\", count(*) AS periods, count(*) FILTER (WHERE event) AS events, round(avg(event::INT), 8) AS rate, min(t) FILTER (WHERE event) AS first_t, max(t) FILTER (WHERE event) AS last_t FROM g GROUP BY grp")
def events_by_group(spark, sf_dir):
    """Events, rate and timing by group."""
    return _risk(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("group")).agg(F.count("*").alias("periods"), F.count_if("event").alias("events"), F.round(F.avg(F.col("event").cast("int")), 8).alias("rate"), F.min(F.when(F.col("event"), F.col("t"))).alias("first_t"), F.max(F.when(F.col("event"), F.col("t"))).alias("last_t"))


@query(f"WITH {_RISK} SELECT user_id, t // 7 AS week, bool_or(event) AS event, count(*) AS periods, round(sum(load), 4) AS load FROM risk GROUP BY ALL")
def risk_collapse(spark, sf_dir):
    """A risk set in longer periods, with its load."""
    return _risk(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 7).alias("week")).agg(F.bool_or("event").alias("event"), F.count("*").alias("periods"), F.round(F.sum("load"), 4).alias("load"))


@query(f"""WITH {_RISK}, u AS (SELECT *, ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM risk),
  s AS (SELECT 'unit' AS arm, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'calibration' ELSE 'test' END AS split, user_id, event FROM u UNION ALL SELECT 'time', CASE WHEN t <= 2 THEN 'train' ELSE 'test' END, user_id, event FROM risk)
  SELECT arm, split, count(*) AS "rows", count(DISTINCT user_id) AS units, count(*) FILTER (WHERE event) AS events, NOT bool_or(event) AS eventless FROM s GROUP BY ALL""")
def split_reports(spark, sf_dir):
    """Whole units in three parts, and everything up to a time against what follows; parts without events are named."""
    risk = _risk(spark, sf_dir)
    u = F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    by_unit = resample.split_report(resample.split(risk, "user_id", {"train": 0.6, "calibration": 0.2, "test": 0.2}, u=u), "user_id", "event")
    by_time = resample.split_report(resample.split_by_time(risk, "t", 2), "user_id", "event")
    return by_unit.withColumn("arm", F.lit("unit")).unionByName(by_time.withColumn("arm", F.lit("time")))


@query(f"WITH {_RISK}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rk FROM risk) SELECT user_id % 5 AS \"group\", count(*) AS units, round(avg(load), 6) AS entry_load, round(avg(t), 6) AS entry_t FROM r WHERE rk = 1 GROUP BY user_id % 5")
def entry_row_means(spark, sf_dir):
    """Means over each unit's first row."""
    first = _risk(spark, sf_dir).groupBy("user_id").agg(F.min(F.struct("t", "load")).alias("f"))
    return first.groupBy((F.col("user_id") % 5).alias("group")).agg(F.count("*").alias("units"), F.round(F.avg("f.load"), 6).alias("entry_load"), F.round(F.avg("f.t"), 6).alias("entry_t"))


@query("""WITH g AS (SELECT c_custkey AS unit, t FROM customer, range(1, 9) x(t)), u AS (SELECT unit, t, (unit % 10) / 10.0::DOUBLE AS x, ('0x' || substr(md5(unit::VARCHAR || ':' || t::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM g),
  h AS (SELECT *, 1 - exp(-exp(-2.0::DOUBLE + x + 0.1::DOUBLE * t)) AS hazard FROM u), e AS (SELECT *, min(CASE WHEN u < hazard THEN t END) OVER (PARTITION BY unit) AS first_t FROM h) SELECT unit, t, x, round(hazard, 8) AS hazard, u < hazard AS event FROM e WHERE first_t IS NULL OR t <= first_t""")
def hazard_fixture(spark, sf_dir):
    """Person-periods with a known complementary log-log hazard, drawn by a digest so that any engine draws alike."""
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("t"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("unit").cast("string"), F.col("t").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = g.withColumn("x", (F.col("unit") % 10) / F.lit(10.0)).withColumn("hazard", 1 - F.exp(-F.exp(-2.0 + F.col("x") + 0.1 * F.col("t")))).withColumn("event", u < F.col("hazard"))
    at = F.min(F.when(F.col("event"), F.col("t"))).over(Window.partitionBy("unit"))
    return rows.withColumn("at", at).filter("at IS NULL OR t <= at").select("unit", "t", "x", F.round("hazard", 8).alias("hazard"), "event")


# --- reports -------------------------------------------------------------------------------------------------------


@query("SELECT year(o_orderdate) AS vintage, count(*) AS n, round(avg((o_totalprice > 100000)::INT), 8) AS coverage, round(avg((o_totalprice > 100000)::INT), 8) >= 0.6 AS usable FROM orders GROUP BY ALL")
def vintage_gates(spark, sf_dir):
    """Vintages whose coverage reaches the floor."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("vintage"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("measure"))
    return facilities.vintage_gate(o, "vintage", "measure", 0.6).withColumn("coverage", F.round("coverage", 8)).withColumn("usable", F.col("coverage") >= 0.6)


@query(f"""WITH {PLACES}, r AS (SELECT place, households * exp(-1.2::DOUBLE + 0.3::DOUBLE * ln(coalesce(income, 50000) / 10000) - 0.01::DOUBLE * land) AS raw FROM places), s AS (SELECT place, raw * 1000000.0 / sum(raw) OVER () AS demand FROM r), k AS (SELECT *, cume_dist() OVER (ORDER BY round(demand, 6)) AS c FROM s)
  SELECT place, round(demand, 6) AS demand, CASE WHEN c <= 0.25 THEN 'low' WHEN c <= 0.75 THEN 'middle' ELSE 'high' END AS band FROM k""")
def household_demand(spark, sf_dir):
    """A fitted log rate applied to places, scaled to the national total, in bands by share of places."""
    raw = places(spark, sf_dir).select("place", (F.col("households") * F.exp(-1.2 + 0.3 * F.log(F.coalesce("income", F.lit(50000.0)) / 10000) - 0.01 * F.col("land"))).alias("raw"))
    d = raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("all")))).select("place", F.round(F.col("raw") * 1000000.0 / F.col("all"), 6).alias("demand"))
    # shares from counts per distinct value, so that no task orders all places
    by = d.groupBy("demand").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.orderBy("demand"))
    cut = by.withColumn("c", below / F.sum("n").over(Window.partitionBy(F.lit(1)))).select("demand", F.when(F.col("c") <= 0.25, "low").when(F.col("c") <= 0.75, "middle").otherwise("high").alias("band"))
    return d.join(cut, "demand").select("place", "demand", "band")


_BINARY = f"""{PLACES}, m AS (SELECT place, county_id, round(1 / (1 + exp(-score / 4000)), 6) AS p, score > 3000 OR place % 7 = 0 AS y, ('0x' || substr(md5(place::VARCHAR), 1, 8))::BIGINT % 2 = 0 AS fitting FROM places),
  s AS (SELECT CASE WHEN y THEN 1 - p ELSE p END AS s FROM m WHERE fitting), k AS (SELECT ceil((count(*) + 1) * 0.9)::BIGINT AS k FROM s), q AS (SELECT max(s) AS q FROM (SELECT s, row_number() OVER (ORDER BY s) AS r FROM s), k WHERE r <= k),
  t AS (SELECT county_id, p, y, 1 - p <= q + 1e-12 AS yes, p <= q + 1e-12 AS no FROM m, q WHERE NOT fitting)"""


@query(f"""WITH {_BINARY} SELECT county_id, count(*) AS n, round(avg((CASE WHEN y THEN yes ELSE no END)::INT), 8) AS coverage, round(avg((yes AND no)::INT), 8) AS both, round(avg((NOT yes AND NOT no)::INT), 8) AS neither, round(avg((yes <> no)::INT), 8) AS decided FROM t GROUP BY county_id""")
def conformal_binary(spark, sf_dir):
    """Split-conformal yes/no sets, calibrated on one half of the places and reported on the other by county."""
    half = F.conv(F.substring(F.md5(F.col("place").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 2 == 0
    m = places(spark, sf_dir).select("place", "county_id", F.round(1 / (1 + F.exp(-F.col("score") / 4000)), 6).alias("p"), ((F.col("score") > 3000) | (F.col("place") % 7 == 0)).alias("y"), half.alias("fitting"))
    q = metrics.conformal_quantile(m.filter("fitting").select(F.when(F.col("y"), 1 - F.col("p")).otherwise(F.col("p")).alias("s")), "s", 0.1)
    out = metrics.binary_sets(m.filter("NOT fitting"), "p", q, slack=1e-12)
    share = lambda c: F.round(F.avg(c.cast("int")), 8)
    yes, no = F.col("yes"), F.col("no")
    return out.groupBy("county_id").agg(F.count("*").alias("n"), share(F.when(F.col("y"), yes).otherwise(no)).alias("coverage"), share(yes & no).alias("both"), share(~yes & ~no).alias("neither"), share(yes != no).alias("decided"))


@query("""WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%d %b %Y') AS d, (o_orderkey % 900 + 100)::VARCHAR || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || ' sq ft' AS a, 'site ' || ['dws', 'bfi', 'stl'][o_orderkey % 3 + 1] || (o_orderkey % 9 + 1)::VARCHAR || ' east' AS c, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
  SELECT id, y AS year, m AS month, (m + 2) // 3 AS quarter, (id % 900 + 100) * 1000.0 + id % 1000 AS sqft, ['DWS', 'BFI', 'STL'][id % 3 + 1] || (id % 9 + 1)::VARCHAR AS code FROM o""")
def scanned_fields(spark, sf_dir):
    """Dates in words, floor areas and codes read from text."""
    from gridfold.functions.fields import facility_code, floor_area, text_date

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.date_format("o_orderdate", "dd MMM yyyy").alias("d"), F.concat((k % 900 + 100).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" sq ft")).alias("a"),
        F.concat(F.lit("site "), F.element_at(F.array(*[F.lit(x) for x in ("dws", "bfi", "stl")]), (k % 3 + 1).cast("int")), (k % 9 + 1).cast("string"), F.lit(" east")).alias("c"),
    )
    when = text_date(F.col("d"))
    return o.select("id", when["year"].cast("long").alias("year"), when["month"].cast("long").alias("month"), when["quarter"].cast("long").alias("quarter"), floor_area(F.col("a")).alias("sqft"), facility_code(F.col("c")).alias("code"))


@query(f"""WITH {PLACES}, {SITES} SELECT place, site, round(2 * 3958.8 * asin(sqrt(least(1.0, pow(sin((radians(site_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(site_lat)) * pow(sin((radians(site_lon) - radians(lon)) / 2), 2)))), 6) AS miles,
  sin(radians(lat)) * sin(radians(site_lat)) + cos(radians(lat)) * cos(radians(site_lat)) * cos(radians(lon) - radians(site_lon)) >= cos(50 / 3958.8::DOUBLE) AS near FROM places JOIN sites ON county_id = site_county_id AND place % 40 = site % 40""")
def distances(spark, sf_dir):
    """F1 F2: great-circle miles and the dot-product test, for places and sites of one county and group."""
    p, s = places(spark, sf_dir).withColumn("g", F.col("place") % 40), sites(spark, sf_dir).withColumn("g", F.col("site") % 40)
    both = p.join(s, (p.county_id == s.site_county_id) & (p.g == s.g))
    return both.select("place", "site", F.round(C.haversine("lat", "lon", "site_lat", "site_lon", 3958.8), 6).alias("miles"), C.within(C.closeness("lat", "lon", "site_lat", "site_lon"), 50, 3958.8).alias("near"))
