"""Joins, aggregates, windows, top-k, set operations and scalars on the generated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridfold.functions import columns as C
from gridfold.functions.ordered import tertile, top_k
from gridfold.operators.asof import latest_before, strictly_prior
from gridfold.operators.quality import Sentinel, flag_sentinels
from gridfold.operators.quality import grain_violations as violations
from gridfold.plans.registry import query
from gridfold.plans.stand_ins import PLACES, places, table


@query("SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY rows DESC, l_orderkey, l_partkey LIMIT 3")
def grain_violations(spark, sf_dir):
    """A14 J19."""
    return violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""SELECT l_suppkey, max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS max_returned, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS sum_a, bool_or(l_discount >= 0.1) AS any_top_discount, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey""")
def pivot_conditional(spark, sf_dir):
    """A2 A12."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max(F.when(flag == "R", F.col("l_extendedprice"))).alias("max_returned"), F.round(F.sum(F.when(flag == "A", F.col("l_quantity"))), 2).alias("sum_a"), F.bool_or(F.col("l_discount") >= 0.1).alias("any_top_discount"), F.count_distinct("l_partkey").alias("parts"))


_WEIGHTED = "SELECT county_id, CASE WHEN place % 7 <> 0 THEN income END AS x, CASE WHEN place % 11 <> 0 THEN households END AS w, lat, lon FROM places"


def _weighted(spark, sf_dir):
    return places(spark, sf_dir).select("county_id", F.when(F.col("place") % 7 != 0, F.col("income")).alias("x"), F.when(F.col("place") % 11 != 0, F.col("households")).alias("w"), "lat", "lon")


@query(f"WITH {PLACES}, p AS ({_WEIGHTED}) SELECT county_id, round(sum(x * w) / nullif(sum(w), 0), 4) AS mean FROM p GROUP BY county_id")
def weighted_mean_sql(spark, sf_dir):
    """A missing value's weight stays in the denominator."""
    return _weighted(spark, sf_dir).groupBy("county_id").agg(F.round(C.weighted_mean("x", "w"), 4).alias("mean"))


@query(f"""WITH {PLACES}, p AS ({_WEIGHTED}) SELECT county_id, round(sum(x * w) FILTER (WHERE x IS NOT NULL) / nullif(sum(w) FILTER (WHERE x IS NOT NULL), 0), 4) AS mean, round(coalesce(sum(lat * w) / nullif(sum(w), 0), avg(lat)), 6) AS lat, round(coalesce(sum(lon * w) / nullif(sum(w), 0), avg(lon)), 6) AS lon FROM p GROUP BY county_id""")
def weighted_mean_complete(spark, sf_dir):
    """Complete cases, and a weighted centroid with a plain one to fall back on."""
    centroid = lambda c: F.round(F.coalesce(C.weighted_mean_complete(c, "w"), F.avg(c)), 6).alias(c)
    return _weighted(spark, sf_dir).groupBy("county_id").agg(F.round(C.weighted_mean_complete("x", "w"), 4).alias("mean"), centroid("lat"), centroid("lon"))


@query("""WITH w AS (SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH'), 2) AS high, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 2) AS low FROM orders GROUP BY o_custkey)
  SELECT o_custkey, priority, value FROM w UNPIVOT (value FOR priority IN (urgent, high, low))""")
def unpivot_long(spark, sf_dir):
    """SC8 SC11 A22: pivot with a closed list, then wide to long without nulls."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderpriority", list(names)).agg(F.round(F.sum("o_totalprice"), 2)).withColumnsRenamed(names)
    return wide.unpivot("o_custkey", list(names.values()), "priority", "value").filter("value IS NOT NULL")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS vintage, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS priority FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999")
def stack_vintages(spark, sf_dir):
    """SC12 U1 U5: yearly files stacked by name; a column that early ones lack is null."""
    orders = table(spark, sf_dir, "orders")
    parts = []
    for year in range(1996, 2000):
        own = orders.filter(F.year("o_orderdate") == year).select("o_orderkey", F.lit(year).alias("vintage"), *([F.col("o_orderpriority").alias("priority")] if year >= 1998 else []))
        parts.append(own)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("o_orderkey", "vintage", F.col("priority").cast("string").alias("priority"))


@query("SELECT c_custkey, coalesce(c_acctbal >= 9000, false) AS balance_topcoded, coalesce(c_acctbal <= -900, false) AS balance_bottomcoded, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END IS NULL AS segment_imputed FROM customer")
def sentinel_flags(spark, sf_dir):
    """P2 S8."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")).alias("segment"))
    rules = [Sentinel("c_acctbal", "TOP", "balance_topcoded", 9000), Sentinel("c_acctbal", "BOTTOM", "balance_bottomcoded", -900), Sentinel("segment", "ABSENT", "segment_imputed")]
    return flag_sentinels(rows, rules).drop("c_acctbal", "segment")


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '(X)' WHEN 1 THEN '$1,234.5' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE value::VARCHAR END AS raw, json_extract_string(props, '$.k') AS k FROM events)
  SELECT event_id, round(TRY_CAST(regexp_replace(trim(raw), '[,$ ]', '', 'g') AS DOUBLE), 6) AS value, coalesce(TRY_CAST(regexp_replace(trim(raw), '[,$ ]', '', 'g') AS DOUBLE) IS NULL AND trim(raw) <> '', false) AS suppressed, CASE WHEN k IN ('0', '1') THEN NULL ELSE k::BIGINT END AS k FROM r""")
def try_numeric(spark, sf_dir):
    """P3 S2 SC9 SC13 F11 P12: numbers where they parse, suppressed cells, substitute codes."""
    n = F.col("event_id") % 5
    raw = F.when(n == 0, "(X)").when(n == 1, "$1,234.5").when(n == 2, "").when(n == 4, F.col("value").cast("string"))
    value, suppressed = C.number_flagged("raw")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), F.get_json_object("props", "$.k").alias("k"))
    return rows.select("event_id", F.round(value, 6).alias("value"), suppressed.alias("suppressed"), C.null_codes("k", ["0", "1"]).cast("long").alias("k"))


@query("""WITH v AS (SELECT o_custkey AS k, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY ALL),
  d AS (SELECT c_custkey AS k, 1996 + c_custkey % 6 AS decided FROM customer)
  SELECT d.k, d.decided, max(v.year) AS year_used, arg_max(v.spent, v.year) AS spent FROM d JOIN v ON d.k = v.k AND v.year < d.decided GROUP BY ALL""")
def vintage_asof(spark, sf_dir):
    """The latest strictly earlier vintage."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1996 + F.col("c_custkey") % 6).alias("decided"))
    return latest_before(d, v, ["k"], "decided", "year", ["spent"])


@query("""WITH f AS (SELECT c_custkey, c_nationkey AS k, min(year(o_orderdate)) AS opened FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
  SELECT a.c_custkey, a.k, a.opened, count(b.c_custkey) AS earlier, max(b.opened) AS last_before, count(b.c_custkey) = 0 AS first_in_group FROM f a LEFT JOIN f b ON a.k = b.k AND b.opened < a.opened GROUP BY ALL""")
def prior_in_group(spark, sf_dir):
    """Entities strictly before, in the same group."""
    opened = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).cast("long").alias("opened"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")).join(opened, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
    out = strictly_prior(rows, ["k"], "opened", {"earlier": F.count("c_custkey"), "last_before": F.max("opened")})
    return out.withColumn("first_in_group", F.col("earlier") == 0)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_members(spark, sf_dir):
    """J6."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_members(spark, sf_dir):
    """The donors left."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT region, county, count(*) AS places, round(sum(households), 1) AS households, grouping(county)::INT AS total FROM (SELECT coalesce(r_name, '-') AS region, n_name AS county, (100 + c_custkey * 17 % 900)::DOUBLE AS households FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (region, county) HAVING region IS NOT NULL""")
def rollup_totals(spark, sf_dir):
    """Groups with their hand-built total rows, as a rollup."""
    geo = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("county"), (100 + F.col("c_custkey") * 17 % 900).cast("double").alias("households"))
    return rows.rollup("region", "county").agg(F.count("*").alias("places"), F.round(F.sum("households"), 1).alias("households"), F.grouping("county").cast("int").alias("total")).filter("region IS NOT NULL")


@query("""WITH y AS (SELECT c_nationkey::BIGINT AS k, year(o_orderdate) AS year, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (c_nationkey % 3 = 0 AND year(o_orderdate) = 1997) GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY year) AS before FROM y)
  SELECT k, year, round(v, 2) AS v, round(CASE WHEN before > 0 THEN 100.0 * (v - before) / before END, 6) AS row_yoy FROM l""")
def yoy_row_lag(spark, sf_dir):
    """Change against the previous row, across gaps."""
    nations = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("k"))
    rows = table(spark, sf_dir, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey")).filter(~((F.col("k") % 3 == 0) & (F.year("o_orderdate") == 1997)))
    y = rows.groupBy("k", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    before = F.lag("v").over(Window.partitionBy("k").orderBy("year"))
    return y.withColumn("before", before).select("k", "year", F.round("v", 2).alias("v"), F.round(C.yoy("v", "before"), 6).alias("row_yoy"))


@query(f"""WITH {PLACES}, g AS (SELECT *, avg(households) OVER (PARTITION BY county_id) AS mh, avg(score) OVER (PARTITION BY county_id) AS ms FROM places),
  c AS (SELECT county_id, stddev_samp(households) / nullif(avg(households), 0) AS cv FROM places GROUP BY county_id)
  SELECT round(corr(households - mh, score - ms), 6) AS demeaned_corr, (SELECT round(avg(cv), 6) FROM c) AS mean_cv, (SELECT round(avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT county_id, count(DISTINCT metro) AS n FROM places GROUP BY county_id)) AS constant_share FROM g""")
def group_demean_corr(spark, sf_dir):
    """A23 W5."""
    p = places(spark, sf_dir)
    group = Window.partitionBy("county_id")
    demeaned = p.withColumns({"h": F.col("households") - F.avg("households").over(group), "s": F.col("score") - F.avg("score").over(group)}).agg(F.round(F.corr("h", "s"), 6).alias("demeaned_corr"))
    by = p.groupBy("county_id").agg((F.stddev_samp("households") / F.nullif(F.avg("households"), F.lit(0.0))).alias("cv"), F.count_distinct("metro").alias("n"))
    rest = by.agg(F.round(F.avg("cv"), 6).alias("mean_cv"), F.round(F.avg(F.when(F.col("n") <= 1, 1.0).otherwise(0.0)), 6).alias("constant_share"))
    return demeaned.crossJoin(rest)


@query(f"""WITH {PLACES}, m AS (SELECT county_id, quantile_cont(households, 0.5) AS med, min(households) FILTER (WHERE households > 200) AS floor FROM places GROUP BY county_id)
  SELECT place, round(ln(greatest(households, floor) / med), 6) AS log_relative, round(households / nullif(land, 0), 6) AS per_area FROM places JOIN m USING (county_id)""")
def log_relative(spark, sf_dir):
    """Log of the ratio to the group's median, small values lifted to the group's least."""
    p = places(spark, sf_dir)
    m = p.groupBy("county_id").agg(F.median("households").alias("med"), F.min(F.when(F.col("households") > 200, F.col("households"))).alias("floor"))
    return p.join(m, "county_id").select("place", F.round(F.log(F.greatest("households", "floor") / F.col("med")), 6).alias("log_relative"), F.round(F.col("households") / F.nullif("land", F.lit(0.0)), 6).alias("per_area"))


@query("""WITH e AS (SELECT user_id, CAST(date_part('day', ts) AS BIGINT) AS t, bool_or(event_type = 'purchase') AS event FROM events GROUP BY ALL), f AS (SELECT *, min(CASE WHEN event THEN t END) OVER (PARTITION BY user_id) AS first_event FROM e)
  SELECT user_id, t, event FROM f WHERE t > 1 AND (first_event IS NULL OR (t <= first_event AND first_event > 1))""")
def risk_set(spark, sf_dir):
    """Person-periods up to the first event; left-truncated units go."""
    from gridfold.operators.hazard import risk_set as build

    e = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("t")).agg(F.bool_or(F.col("event_type") == "purchase").alias("event"))
    return build(e, "user_id", "t", "event", first=1)


@query(f"""WITH {PLACES}, r AS (SELECT *, row_number() OVER (PARTITION BY county_id ORDER BY households, place) AS rk, count(*) OVER (PARTITION BY county_id) AS n FROM places)
  SELECT place, CASE WHEN rk <= 1 + (n - 1) / 3.0 THEN 1 WHEN rk <= 1 + (n - 1) * 2 / 3.0 THEN 2 ELSE 3 END AS tertile FROM r""")
def household_tertiles(spark, sf_dir):
    """W11."""
    return places(spark, sf_dir).select("place", tertile(F.col("households"), F.col("place"), F.col("county_id")).alias("tertile"))


@query(f"""WITH {PLACES}, m AS (SELECT *, max(score) OVER (PARTITION BY county_id) AS top FROM places), e AS (SELECT *, exp((score - top) / 1000) AS e FROM m)
  SELECT place, round(e / sum(e) OVER (PARTITION BY county_id), 8) AS p, round(households / sum(households) OVER (PARTITION BY county_id), 8) AS share FROM e""")
def group_softmax(spark, sf_dir):
    """W7 W12 W13."""
    group = Window.partitionBy("county_id")
    e = places(spark, sf_dir).withColumn("e", F.exp((F.col("score") - F.max("score").over(group)) / 1000))
    return e.select("place", F.round(F.col("e") / F.sum("e").over(group), 8).alias("p"), F.round(F.col("households") / F.sum("households").over(group), 8).alias("share"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_per_group(spark, sf_dir):
    """K3 K4 S15."""
    return top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, F.desc("o_totalprice"), F.col("o_orderkey"))


@query(f"""WITH {PLACES}, r AS (SELECT score, place % 7 = 0 AS event, row_number() OVER (ORDER BY score DESC, place) AS rk FROM places), c AS (SELECT score AS cut FROM r WHERE rk = 100)
  SELECT count(*) FILTER (WHERE rk <= 100 AND event) AS captured, count(*) FILTER (WHERE score = cut) AS ties_at_cut, count(*) FILTER (WHERE event) AS events FROM r, c""")
def topk_ties(spark, sf_dir):
    """K5 K6: events among the highest scores, and the ties at the cut."""
    p = places(spark, sf_dir).select("score", "place", (F.col("place") % 7 == 0).alias("event"))
    top = p.orderBy(F.desc("score"), "place").limit(100)
    cut = top.agg(F.min("score").alias("cut"), F.count_if("event").alias("captured"))
    return p.crossJoin(F.broadcast(cut)).agg(F.first("captured").alias("captured"), F.count_if(F.col("score") == F.col("cut")).alias("ties_at_cut"), F.count_if("event").alias("events"))


@query(f"WITH {PLACES}, g AS (SELECT county_id, max(score) AS best, count(*) AS members FROM places GROUP BY county_id) SELECT county_id, best, members, row_number() OVER (ORDER BY best DESC, county_id) AS rank FROM g")
def rank_groups(spark, sf_dir):
    """Groups by their best member."""
    g = places(spark, sf_dir).groupBy("county_id").agg(F.max("score").alias("best"), F.count("*").alias("members"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best"), "county_id")).cast("long"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
  SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'a_minus_b', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_operations(spark, sf_dir):
    """U2 U3."""
    orders = table(spark, sf_dir, "orders")
    a, b = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct(), orders.filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    n = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.subtract(b), "a_minus_b"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'metal' WHEN regexp_matches(p_type, '^PROMO') THEN 'promotion' WHEN regexp_matches(p_type, 'BRASS$') THEN 'brass' ELSE 'other' END AS class, round(TRY_CAST(regexp_replace('$' || p_retailprice::VARCHAR, '[,$ ]', '', 'g') AS DOUBLE), 4) AS price FROM part""")
def regex_classify(spark, sf_dir):
    """Ordered patterns, money."""
    t = F.col("p_type")
    label = F.when(t.rlike("STEEL|TIN"), "metal").when(t.rlike("^PROMO"), "promotion").when(t.rlike("BRASS$"), "brass").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("class"), F.round(C.number(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))), 4).alias("price"))


@query("""WITH p AS (SELECT c_nationkey::BIGINT AS k, o_orderkey, o_orderdate, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT k, strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_case, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price, count(DISTINCT o_orderpriority) AS kinds, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS kind_set, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM p GROUP BY k""")
def place_collapse(spark, sf_dir):
    """A row per place, with its first case and the set of its kinds."""
    nations = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("k"))
    p = table(spark, sf_dir, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    return p.groupBy("k").agg(F.min("o_orderdate").cast("date").cast("string").alias("earliest"), F.max("o_orderdate").cast("date").cast("string").alias("latest"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_case"), F.round(F.median("o_totalprice"), 4).alias("median_price"), F.count_distinct("o_orderpriority").alias("kinds"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("kind_set"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("""WITH k AS (SELECT quantile_cont(date_part('year', o_orderdate) * 12.0 + date_part('month', o_orderdate), [0.05, 0.35, 0.65, 0.95]) AS q FROM orders), x AS (SELECT o_orderkey, date_part('year', o_orderdate) * 12.0 + date_part('month', o_orderdate) AS x FROM orders)
  SELECT o_orderkey, x::DOUBLE AS x, round((pow(greatest(x - q[1], 0), 3) - pow(greatest(x - q[3], 0), 3) * ((q[4] - q[1]) / (q[4] - q[3])) + pow(greatest(x - q[4], 0), 3) * ((q[3] - q[1]) / (q[4] - q[3]))) / pow(q[4] - q[1], 2), 6) AS s1,
   round((pow(greatest(x - q[2], 0), 3) - pow(greatest(x - q[3], 0), 3) * ((q[4] - q[2]) / (q[4] - q[3])) + pow(greatest(x - q[4], 0), 3) * ((q[3] - q[2]) / (q[4] - q[3]))) / pow(q[4] - q[1], 2), 6) AS s2 FROM x, k""")
def spline_basis(spark, sf_dir):
    """restricted cubic spline at percentile knots."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") * F.lit(12.0) + F.month("o_orderdate")).alias("x"))
    knots = rows.agg(F.percentile("x", [0.05, 0.35, 0.65, 0.95])).first()[0]
    x, s1, s2 = C.cubic_spline("x", knots)
    return rows.select("o_orderkey", x.alias("x"), F.round(s1, 6).alias("s1"), F.round(s2, 6).alias("s2"))


@query("SELECT o_orderkey, strftime(make_date(year(o_orderdate), (quarter(o_orderdate) - 1) * 3 + 1, 1), '%Y-%m-%d') AS quarter_start, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q_index, strftime(o_orderdate, '%Y-%m-%d') AS filed, year(o_orderdate) < 1996 OR o_orderdate::DATE > DATE '2000-12-31' AS implausible FROM orders")
def quarter_dates(spark, sf_dir):
    """Quarter starts, dates in two formats, plausibility flagged rather than dropped."""
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), C.try_dates(text, ["yyyy-MM-dd", "MM/dd/yyyy"]).alias("filed"))
    return rows.select("o_orderkey", C.quarter_start("y", "q").cast("string").alias("quarter_start"), C.quarter_index("y", "q").alias("q_index"), F.col("filed").cast("string").alias("filed"), ((F.col("y") < 1996) | (F.col("filed") > F.lit("2000-12-31").cast("date"))).alias("implausible"))


@query(r"""WITH r AS (SELECT p_partkey, trim(regexp_replace(replace(regexp_replace(upper(CASE p_partkey % 4 WHEN 0 THEN 'St. ' WHEN 1 THEN 'Mt ' WHEN 2 THEN 'City of ' ELSE 'Ft. ' END || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' Township' ELSE '' END), '[.,''`()]', ' ', 'g'), '-', ' '), '\s+', ' ', 'g')) AS t FROM part),
  s AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '^(CITY|TOWN|VILLAGE) OF ', ''), ' (TOWNSHIP|TWP|CITY|BOROUGH)$', '') AS t FROM r)
  SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(t, '^ST ', 'SAINT '), '^MT ', 'MOUNT '), '^FT ', 'FORT ') AS city FROM s""")
def city_normalise(spark, sf_dir):
    """F5."""
    from gridfold.functions.text import city_key

    k = F.col("p_partkey") % 4
    raw = F.concat(F.when(k == 0, "St. ").when(k == 1, "Mt ").when(k == 2, "City of ").otherwise("Ft. "), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, " Township").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", city_key(raw).alias("city"))
