"""Places, sites, openings and costs on the generated star-schema tables, as DataFrames and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.columns import zpad


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place per customer: county is its nation, metro its region (missing for one of them)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    geography = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("county"), F.when(F.col("r_name") != "AFRICA", F.col("r_name")).alias("metro")))
    return table(spark, sf_dir, "customer").join(geography, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        k.alias("place"), zpad("c_custkey", 5).alias("zcta"), "county", "metro", F.col("c_nationkey").cast("long").alias("county_id"),
        (38 + (k * 37 % 400) / F.lit(100.0)).alias("lat"), (-90 + (k * 91 % 600) / F.lit(100.0)).alias("lon"),
        (100 + k * 17 % 900).cast("double").alias("households"), F.when(F.col("c_acctbal") >= 0, 30000 + F.col("c_acctbal") * 10).alias("income"),
        F.when(k % 50 == 0, F.lit(0.0)).otherwise((1 + k % 23).cast("double")).alias("land"), (40000 + k % 7 * 1500).cast("double").alias("wage"), (3.5 + (k % 5) * F.lit(0.2)).alias("diesel"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("score"),
    )


PLACES = """
places AS (SELECT c_custkey AS place, CASE WHEN length(c_custkey::VARCHAR) >= 5 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS zcta,
    n_name AS county, CASE WHEN r_name <> 'AFRICA' THEN r_name END AS metro, c_nationkey::BIGINT AS county_id,
    38 + (c_custkey * 37 % 400) / 100.0::DOUBLE AS lat, -90 + (c_custkey * 91 % 600) / 100.0::DOUBLE AS lon,
    (100 + c_custkey * 17 % 900)::DOUBLE AS households, CASE WHEN c_acctbal >= 0 THEN 30000 + c_acctbal * 10 END AS income,
    CASE WHEN c_custkey % 50 = 0 THEN 0.0::DOUBLE ELSE (1 + c_custkey % 23)::DOUBLE END AS land, (40000 + c_custkey % 7 * 1500)::DOUBLE AS wage,
    3.5::DOUBLE + (c_custkey % 5) * 0.2::DOUBLE AS diesel, c_mktsegment AS segment, c_acctbal AS score
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site per supplier, with the quarters in which it opened and closed (some unknown)."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("site"), F.col("s_nationkey").cast("long").alias("site_county_id"), (38 + (k * 137 % 400) / F.lit(100.0)).alias("site_lat"), (-90 + (k * 311 % 600) / F.lit(100.0)).alias("site_lon"),
        (2015 + k % 8).alias("open_year"), F.when(k % 4 != 3, 1 + k % 4).alias("open_quarter"), F.when(k % 6 == 0, 2019 + k % 4).alias("close_year"), F.when(k % 12 == 0, 1 + k % 3).alias("close_quarter"),
        (1000 + k * 7 % 500).cast("double").alias("mass"), F.when(k % 3 == 0, "FC").when(k % 3 == 1, "SC").otherwise("DS").alias("kind"),
    )


SITES = """
sites AS (SELECT s_suppkey AS site, s_nationkey::BIGINT AS site_county_id, 38 + (s_suppkey * 137 % 400) / 100.0::DOUBLE AS site_lat, -90 + (s_suppkey * 311 % 600) / 100.0::DOUBLE AS site_lon,
    2015 + s_suppkey % 8 AS open_year, CASE WHEN s_suppkey % 4 <> 3 THEN 1 + s_suppkey % 4 END AS open_quarter, CASE WHEN s_suppkey % 6 = 0 THEN 2019 + s_suppkey % 4 END AS close_year, CASE WHEN s_suppkey % 12 = 0 THEN 1 + s_suppkey % 3 END AS close_quarter,
    (1000 + s_suppkey * 7 % 500)::DOUBLE AS mass, CASE s_suppkey % 3 WHEN 0 THEN 'FC' WHEN 1 THEN 'SC' ELSE 'DS' END AS kind FROM supplier)"""


def miles_sql(a: str, b: str, c: str, d: str, radius: float) -> str:
    """Great-circle distance in SQL."""
    return f"2 * {radius} * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"
