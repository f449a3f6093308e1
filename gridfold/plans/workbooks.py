"""Excel sources and their checks, on workbooks made from the generated tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from gridfold.operators import quality
from gridfold.plans.facilities import RAW, raw_facilities
from gridfold.plans.registry import query
from gridfold.plans.stand_ins import table
from gridfold.sources import excel, readers


@query("""SELECT lpad(n_regionkey::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 3, '0') AS county_geoid, n_name AS county_name, (10000 + n_regionkey)::VARCHAR AS cbsa_code, r_name AS cbsa_title, NULL::VARCHAR AS csa_title,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Micropolitan Statistical Area' ELSE 'Metropolitan Statistical Area' END AS area_type, n_nationkey % 3 <> 0 AS is_metro, CASE WHEN n_nationkey % 2 = 0 THEN 'Central' ELSE 'Outlying' END AS county_role FROM nation JOIN region ON n_regionkey = r_regionkey""")
def excel_counties(spark, sf_dir):
    """SC7: a metro delineation from a workbook with two title rows and a footnote; nations (25 of them) are its counties."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    head = ["CBSA Code", "CBSA Title", "CSA Title", "Metropolitan/Micropolitan Statistical Area", "FIPS State Code", "FIPS County Code", "County/County Equivalent", "Central/Outlying County"]
    body = [[10000 + r.n_regionkey, r.r_name, None, ("Micro" if r.n_nationkey % 3 == 0 else "Metro") + "politan Statistical Area", str(r.n_regionkey), r.n_nationkey, r.n_name, "Outlying" if r.n_nationkey % 2 else "Central"] for r in rows]
    book = excel.workbook([["List of areas"], ["Delineation"], head, *body, ["Note: a & b"]])
    return excel.metro_counties(excel.table(spark.createDataFrame([("delineation.xlsx", book)], "path string, content binary"), header=2))


@query("""SELECT n_nationkey::VARCHAR AS area, CASE n_nationkey % 4 WHEN 0 THEN '53-7065' WHEN 1 THEN '53-3033' WHEN 2 THEN '11-1021' ELSE '53-7062' END AS occ_code, CASE WHEN n_nationkey % 5 > 1 THEN 30000.0 + n_nationkey * 1000 END AS annual_mean_wage, n_nationkey % 5 = 0 AS wage_suppressed
  FROM nation WHERE n_nationkey % 4 <> 2""")
def excel_wages(spark, sf_dir):
    """SC9: occupations from a workbook inside a zip; withheld cells (#) are flagged, blank ones aren't."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    wage = lambda k: "#" if k % 5 == 0 else None if k % 5 == 1 else f"{30 + k},000"
    book = excel.workbook([["area", "occ_code", "a_mean"], *[[r.n_nationkey, ("53-7065", "53-3033", "11-1021", "53-7062")[r.n_nationkey % 4], wage(r.n_nationkey)] for r in rows]])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("wages/MSA_dl.XLSX", book)
    files = spark.createDataFrame([("wages.zip", out.getvalue())], "path string, content binary")
    return readers.wages(excel.table(files, member="msa_dl.xlsx"), ["53-7065", "53-3033", "53-7062"])


@query(f"""WITH {RAW}, c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE length(zip) < 5) AS e1, count(*) FILTER (WHERE NOT regexp_full_match(open_year, '[0-9]+')) AS e2, count(*) FILTER (WHERE open_quarter NOT IN ('1', '2', '3', '4')) AS e3,
    count(*) FILTER (WHERE lower(trim(status)) = 'closed' AND close_year IS NULL) AS e4, count(*) FILTER (WHERE try_cast(close_year AS INT) < try_cast(open_year AS INT)) AS e5, count(*) FILTER (WHERE kind NOT IN ('FC', 'SC', 'DS')) AS w1, count(*) FILTER (WHERE lower(trim(status)) NOT IN ('open', 'closed', '')) AS w2,
    count(*) FILTER (WHERE open_quarter IS NOT NULL) AS s1, count(*) FILTER (WHERE kind = 'DS') AS s2 FROM raw)
  SELECT u.level, u.name, u.n, CASE u.level WHEN 'error' THEN u.n = 0 END AS ok FROM c, LATERAL (VALUES ('error', 'short zip', e1), ('error', 'opening year is no number', e2), ('error', 'opening quarter', e3), ('error', 'closed without a year', e4), ('error', 'closes before it opens', e5), ('warning', 'unknown kind', w1), ('warning', 'unknown status', w2), ('stat', 'rows', rows), ('stat', 'with a quarter', s1), ('stat', 'delivery stations', s2)) u(level, name, n)""")
def facility_check(spark, sf_dir):
    """Errors, warnings and figures of a facility table, in one pass."""
    raw = raw_facilities(spark, sf_dir)
    status, year = F.lower(F.trim("status")), lambda c: F.col(c).try_cast("int")
    errors = {
        "short zip": F.length("zip") < 5, "opening year is no number": ~F.col("open_year").rlike("^[0-9]+$"), "opening quarter": ~F.col("open_quarter").isin("1", "2", "3", "4"),
        "closed without a year": (status == "closed") & F.col("close_year").isNull(), "closes before it opens": year("close_year") < year("open_year"),
    }
    warnings = {"unknown kind": ~F.col("kind").isin("FC", "SC", "DS"), "unknown status": ~status.isin("open", "closed", "")}
    stats = {"rows": F.lit(True), "with a quarter": F.col("open_quarter").isNotNull(), "delivery stations": F.col("kind") == "DS"}
    return quality.check_report(raw, ["site", "zip", "status", "open_year", "open_quarter", "close_year", "kind"], errors, warnings, stats)
