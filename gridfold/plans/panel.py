"""Star schema and the dense place-by-time panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.columns import quarter_id, quarter_index, yoy
from gridfold.operators.quality import check_grain
from gridfold.plans.registry import query
from gridfold.plans.stand_ins import PLACES, places, table

COST_INPUTS = ("households", "income", "land", "wage", "diesel")


def dim_quarter_of(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Year x quarter, from generators."""
    years = spark.range(first, last + 1).select(F.col("id").alias("year"))
    return years.select("year", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("quarter")).select("year", "quarter", quarter_id("year", "quarter").alias("date_id"), quarter_index("year", "quarter").alias("q_index"))


def dim_scenario(spark: SparkSession, seed: int, label: str = "baseline") -> DataFrame:
    """The one-row replay key."""
    return spark.createDataFrame([(0, label, seed)], "scenario_id int, label string, seed long")


def dense(entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Every entity in every period. periods is a calendar (a few hundred rows at most)."""
    return entities.crossJoin(F.broadcast(periods))


def build_panel(entities: DataFrame, periods: DataFrame, facts: DataFrame, key: str, measure: str, others: dict[str, Column] | None = None) -> DataFrame:
    """Dense entity x quarter panel of a measure: value, that of the same quarter a calendar year before, percent change, observed flag.

    facts has the key, year, quarter and the measure, at any grain: it is added up before the joins, so they cannot fan out.
    """
    summed = facts.groupBy(key, "year", "quarter").agg(F.sum(measure).alias(measure), *[v.alias(k) for k, v in (others or {}).items()])
    before = summed.select(key, (F.col("year") + 1).alias("year"), "quarter", F.col(measure).alias(f"{measure}_prior"))
    grid = dense(entities, periods).join(summed, [key, "year", "quarter"], "left").join(before, [key, "year", "quarter"], "left")
    return grid.withColumns({f"{measure}_yoy_pct": yoy(measure, f"{measure}_prior"), f"{measure}_observed": F.col(measure).isNotNull()})


def write_panel(panel: DataFrame, path: str, key: list[str]) -> None:
    """Checks the grain, then writes the panel by year, sorted by key within files."""
    check_grain(panel, key).sortWithinPartitions(*key).write.mode("overwrite").partitionBy("year").parquet(path)


def optional_block(df: DataFrame, key: str, taken: list[str], year: str = "year", quarter: str | None = None) -> DataFrame | None:
    """A source of unknown shape as a joinable block: numeric columns averaged by key and period; None where it has no key or period."""
    if key not in df.columns or year not in df.columns:
        return None
    keys = [key, year, *([quarter] if quarter and quarter in df.columns else [])]
    numeric = [c for c, t in df.dtypes if c not in keys and c not in taken and t in ("double", "float", "int", "bigint", "smallint", "tinyint") or (t.startswith("decimal") and c not in keys and c not in taken)]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric]) if numeric else None


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations = customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("nation_id"))
    return orders.join(nations, orders.o_custkey == nations.c_custkey).select("nation_id", F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter"), F.col("o_totalprice").alias("revenue"))


def _years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    r = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return r[0], r[1]


YEARS = "years AS (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year FROM orders), quarters AS (SELECT year, quarter FROM years, (SELECT unnest(range(1, 5)) AS quarter))"
FACTS = "facts AS (SELECT c_nationkey::BIGINT AS nation_id, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
PANEL = f"""{YEARS}, {FACTS}, panel AS (SELECT n_nationkey::BIGINT AS nation_id, n_name AS nation, q.year, q.quarter, q.year::VARCHAR || 'Q' || q.quarter::VARCHAR AS date_id, f.revenue, p.revenue AS revenue_prior,
      CASE WHEN p.revenue > 0 THEN 100.0 * (f.revenue - p.revenue) / p.revenue END AS revenue_yoy_pct, f.revenue IS NOT NULL AS revenue_observed
    FROM nation CROSS JOIN quarters q LEFT JOIN facts f ON f.nation_id = n_nationkey AND f.year = q.year AND f.quarter = q.quarter
    LEFT JOIN facts p ON p.nation_id = n_nationkey AND p.year = q.year - 1 AND p.quarter = q.quarter)"""


def panel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation_id"), F.col("n_name").alias("nation"))
    return build_panel(nations, dim_quarter_of(spark, *_years(spark, sf_dir)), _order_facts(spark, sf_dir), "nation_id", "revenue").drop("q_index")


@query(f"WITH {PANEL} SELECT nation_id, nation, year, quarter, date_id, round(revenue, 2) AS revenue, round(revenue_prior, 2) AS revenue_prior, round(revenue_yoy_pct, 6) AS revenue_yoy_pct, revenue_observed FROM panel")
def dense_panel(spark, sf_dir):
    """The flagship."""
    p = panel_of(spark, sf_dir)
    return p.select("nation_id", "nation", "year", "quarter", "date_id", F.round("revenue", 2).alias("revenue"), F.round("revenue_prior", 2).alias("revenue_prior"), F.round("revenue_yoy_pct", 6).alias("revenue_yoy_pct"), "revenue_observed")


@query(f"WITH {PANEL} SELECT 'nation_id' AS \"column\", count(nation_id) AS non_null, 100.0 * count(nation_id) / count(*) AS pct FROM panel UNION ALL SELECT 'revenue', count(revenue), round(100.0 * count(revenue) / count(*), 6) FROM panel UNION ALL SELECT 'revenue_prior', count(revenue_prior), round(100.0 * count(revenue_prior) / count(*), 6) FROM panel UNION ALL SELECT 'revenue_yoy_pct', count(revenue_yoy_pct), round(100.0 * count(revenue_yoy_pct) / count(*), 6) FROM panel")
def panel_coverage(spark, sf_dir):
    """A13."""
    from gridfold.operators.quality import coverage

    return coverage(panel_of(spark, sf_dir).select("nation_id", "revenue", "revenue_prior", "revenue_yoy_pct")).withColumn("pct", F.round("pct", 6))


@query(f"WITH {YEARS} SELECT year, quarter, year::VARCHAR || 'Q' || quarter::VARCHAR AS date_id, year * 4 + quarter - 1 AS q_index FROM quarters")
def dim_quarter(spark, sf_dir):
    """G3 P13."""
    return dim_quarter_of(spark, *_years(spark, sf_dir))


@query(f"WITH {PLACES} SELECT place, zcta, county, metro, round(lat, 6) AS lat, round(lon, 6) AS lon, households, round(income, 4) AS income, land FROM places")
def dim_place(spark, sf_dir):
    """G1 P1 P7 P9 J1 J2."""
    return places(spark, sf_dir).select("place", "zcta", "county", "metro", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "households", F.round("income", 4).alias("income"), "land")


@query("""WITH k AS (SELECT n_nationkey::BIGINT AS county_id, NULL AS a, n_name AS b FROM nation UNION SELECT c_nationkey::BIGINT, 'county ' || c_nationkey, NULL FROM customer)
  SELECT county_id, coalesce(max(b), max(a)) AS name FROM k GROUP BY county_id""")
def dim_county(spark, sf_dir):
    """Names of two sources, one going before the other."""
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("county_id"), F.lit(None).cast("string").alias("a"), F.col("n_name").alias("b"))
    other = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("county_id"), F.concat(F.lit("county "), F.col("c_nationkey").cast("string")).alias("a"), F.lit(None).cast("string").alias("b"))
    return own.unionByName(other).distinct().groupBy("county_id").agg(F.coalesce(F.max("b"), F.max("a")).alias("name"))


@query(f"""WITH {YEARS}, o AS (SELECT c_nationkey AS k, year(o_orderdate) AS year, count(*) AS n, avg(o_totalprice) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  l AS (SELECT c_nationkey AS k, year(l_shipdate) AS year, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT n_nationkey::BIGINT AS nation_id, y.year, coalesce(n, 0) AS orders, round(mean, 4) AS mean_price, round(quantity, 2) AS quantity FROM nation CROSS JOIN years y LEFT JOIN o ON o.k = n_nationkey AND o.year = y.year LEFT JOIN l ON l.k = n_nationkey AND l.year = y.year""")
def fact_nation_year(spark, sf_dir):
    """A dense grid with measures added up before they are joined."""
    first, last = _years(spark, sf_dir)
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    by_order = orders.groupBy("nation_id", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean_price"))
    by_item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate").join(orders.select("o_orderkey", "nation_id"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("nation_id", F.year("l_shipdate").cast("long").alias("year")).agg(F.sum("l_quantity").alias("quantity"))
    grid = dense(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation_id")), spark.range(first, last + 1).select(F.col("id").alias("year")))
    out = grid.join(by_order, ["nation_id", "year"], "left").join(by_item, ["nation_id", "year"], "left")
    return out.select("nation_id", "year", F.coalesce("orders", F.lit(0)).alias("orders"), F.round("mean_price", 4).alias("mean_price"), F.round("quantity", 2).alias("quantity"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS own, c_mktsegment AS legacy FROM customer),
  m AS (SELECT legacy, arg_min(own, (-n, own)) AS modal FROM (SELECT legacy, own, count(*) AS n FROM s WHERE own IS NOT NULL GROUP BY ALL) GROUP BY legacy)
  SELECT c_custkey, coalesce(own, modal)::INT AS region, CASE WHEN own IS NOT NULL THEN 'own' ELSE 'modal' END AS region_source FROM s LEFT JOIN m USING (legacy) WHERE coalesce(own, modal) IS NOT NULL""")
def vintage_bridge(spark, sf_dir):
    """A place's own region, else the modal region of its legacy area."""
    from gridfold.functions.ordered import smallest_mode

    s = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("own"), F.col("c_mktsegment").alias("legacy"))
    modal = smallest_mode(s, ["legacy"], "own", "modal")
    return s.join(modal, "legacy", "left").select("c_custkey", F.coalesce("own", "modal").cast("int").alias("region"), F.when(F.col("own").isNotNull(), "own").otherwise("modal").alias("region_source")).filter("region IS NOT NULL")


@query("""SELECT l_orderkey, arg_min(l_partkey, (-l_extendedprice, l_linenumber)) AS dominant_part, max(l_extendedprice) AS share FROM lineitem GROUP BY l_orderkey""")
def dominant_member(spark, sf_dir):
    """G9 SC6 S14: the member with the largest share, ties by line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    best = F.min(F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber", "l_partkey"))
    return lines.groupBy("l_orderkey").agg(best.alias("b"), F.max("l_extendedprice").alias("share")).select("l_orderkey", F.col("b.l_partkey").alias("dominant_part"), "share")


@query("""WITH p AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer) SELECT c_custkey, n_name AS county, CASE WHEN n_nationkey IS NULL THEN 'unresolved' WHEN r_name = 'AFRICA' THEN 'outside metro' WHEN c_mktsegment = 'BUILDING' THEN 'ambiguous' ELSE 'resolved' END AS status
  FROM p LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def resolve_status(spark, sf_dir):
    """A status by precedence along left joins."""
    p = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = p.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    status = F.when(F.col("n_nationkey").isNull(), "unresolved").when(F.col("r_name") == "AFRICA", "outside metro").when(F.col("c_mktsegment") == "BUILDING", "ambiguous").otherwise("resolved")
    return j.select("c_custkey", F.col("n_name").alias("county"), status.alias("status"))


@query(f"""WITH {YEARS}, n AS (SELECT c_nationkey AS k, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT n_nationkey::BIGINT AS nation_id, y.year, coalesce(a.n, 0) AS events, b.n AS events_lag1 FROM nation CROSS JOIN years y LEFT JOIN n a ON a.k = n_nationkey AND a.year = y.year LEFT JOIN n b ON b.k = n_nationkey AND b.year = y.year - 1""")
def lagged_covariates(spark, sf_dir):
    """Metro x year counts with the year before, re-keyed."""
    from gridfold.operators.asof import lagged

    first, last = _years(spark, sf_dir)
    counts = _order_facts(spark, sf_dir).groupBy("nation_id", "year").agg(F.count("*").alias("events"))
    grid = dense(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation_id")), spark.range(first, last + 1).select(F.col("id").alias("year")))
    return lagged(grid.join(counts, ["nation_id", "year"], "left"), counts, ["nation_id"], "year", ["events"]).withColumn("events", F.coalesce("events", F.lit(0)))
