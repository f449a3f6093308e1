from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridfold.functions import columns as C
from gridfold.functions import text
from gridfold.functions.ordered import first_by, smallest_mode, tertile


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_zpad_never_cuts(spark):
    assert one(spark, C.zpad("c", 5), c="123456") == "123456"
    assert one(spark, C.zpad("c", 5), c="42") == "00042"
    assert one(spark, C.zpad(F.lit(None).cast("string"), 5)) is None


def test_numbers(spark):
    assert one(spark, C.number("c"), c=" $1,234.5 ") == 1234.5
    assert one(spark, C.number("c"), c="(X)") is None
    value, flag = C.number_flagged("c")
    assert one(spark, flag, c="(X)") is True and one(spark, flag, c=" ") is False


def test_strict_boolean(spark):
    assert [one(spark, C.strict_boolean("c"), c=v) for v in ("Yes", "0", " ", "1.0")] == [True, False, False, True]
    with pytest.raises(Exception, match="not a truth value"):
        one(spark, C.strict_boolean("c"), c="maybe")


@pytest.mark.parametrize(("now", "before", "want"), [(110.0, 100.0, 10.0), (1.0, 0.0, None), (1.0, None, None), (1.0, -5.0, None)])
def test_yoy(spark, now, before, want):
    got = one(spark, C.yoy(F.lit(now), F.lit(before).cast("double")))
    assert got == want


def test_haversine(spark):
    miles = one(spark, C.haversine(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)))
    assert abs(miles - 2446) < 3
    near = one(spark, C.within(C.closeness(F.lit(40.0), F.lit(-90.0), F.lit(40.1), F.lit(-90.0)), 7.0))
    assert near is True


def test_average_and_percentile_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, v double")
    got = {(r.g, r.v): (r.r, r.p) for r in df.select("g", "v", C.average_rank(F.col("v"), F.col("g")).alias("r"), C.percentile_rank(F.col("v"), F.col("g")).alias("p")).collect()}
    assert got == {("a", 1.0): (1.5, 0.5), ("a", 3.0): (3.0, 1.0), ("b", 2.0): (1.0, 1.0)}


def test_modes_and_first(spark):
    df = spark.createDataFrame([("k", 2), ("k", 1), ("k", 1), ("k", 2), ("n", None)], "g string, v int")
    assert [tuple(r) for r in smallest_mode(df, ["g"], "v", "m").collect()] == [("k", 1)]
    assert first_by(df.filter("g = 'k'"), ["g"], F.desc("v")).first().v == 2


def test_tertiles(spark):
    df = spark.range(7).select("id", F.lit(1).alias("v"))
    assert [r.t for r in df.select("id", tertile(F.col("v"), F.col("id"), F.lit(0)).alias("t")).orderBy("id").collect()] == [1, 1, 1, 2, 2, 3, 3]


def test_spline_is_linear_outside(spark):
    knots = [0.0, 1.0, 2.0, 3.0]
    rows = spark.createDataFrame([(x,) for x in (5.0, 6.0, 7.0, -1.0)], "x double")
    got = [tuple(r) for r in rows.select(*[c.alias(f"b{k}") for k, c in enumerate(C.cubic_spline("x", knots))]).collect()]
    for k in (1, 2):
        assert abs((got[2][k] - got[1][k]) - (got[1][k] - got[0][k])) < 1e-9
        assert got[3][k] == 0


def test_hazard_and_decay(spark):
    assert 0.63 < one(spark, C.cloglog_hazard(F.lit(0.0))) < 0.64
    assert one(spark, C.cloglog_hazard(F.lit(1e9))) == 1.0
    assert one(spark, C.half_distance(F.lit(5.0), 5.0)) == 0.5


ADDRESSES = [
    ("315 SHUKSAN WAY DWS4", ("315", "", "SHUKSAN", "WAY", "", "", "DWS4")),
    ("2600 N NORMANDY BLVD, DELTONA, FL 32725", ("2600", "N", "NORMANDY", "BLVD", "", "", "")),
    ("21005 64TH AVENUE S ATTN JESSICA ANG", ("21005", "", "64TH", "AVE", "S", "", "")),
    ("4905 DERRICK RD SW AMAZON MGE8 SORTATION CENTER", ("4905", "", "DERRICK", "RD", "SW", "", "")),
    ("376 ZAPPOS.COM BLVD - 100 W THOMAS PECHOL", ("376", "", "ZAPPOS COM", "BLVD", "", "", "")),
    ("W6331 WALLY WAY", ("W6331", "", "WALLY", "WAY", "", "", "")),
    ("N93W16890 Cleveland Ave", ("N93W16890", "", "CLEVELAND", "AVE", "", "", "")),
    ("3610 NW SAINT HELENS RD", ("3610", "NW", "ST HELENS", "RD", "", "", "")),
    ("3610 NW ST HELENS RD", ("3610", "NW", "ST HELENS", "RD", "", "", "")),
    ("3680 LANGLEY DRIVE SUITE 100", ("3680", "", "LANGLEY", "DR", "", "100", "")),
    ("7555 AIRPORT WAY SW #6162", ("7555", "", "AIRPORT", "WAY", "SW", "6162", "")),
    ("100 W THOMAS P ECHOLS LN 3", ("100", "W", "THOMAS P ECHOLS", "LN", "", "3", "")),
    ("3050 GATEWAY COMMERCE CENTER DR S STL 4", ("3050", "", "GATEWAY COMMERCE CENTER", "DR", "S", "", "STL4")),
    ("1901 140TH AVE E BFI7", ("1901", "", "140TH", "AVE", "E", "", "BFI7")),
    ("4412 W CR 300 N", ("4412", "W", "300", "", "N", "", "")),
    ("4616-6 WEST HOWARD LANE", ("4616-6", "W", "HOWARD", "LN", "", "", "")),
    ("AMAZON.COM BUILDING, 1901 MEADOWVILLE TECH", ("1901", "", "MEADOWVILLE TECH", "", "", "", "")),
    ("5509 MILITARY RD E,", ("5509", "", "MILITARY", "RD", "E", "", "")),
    ("100 N ST", ("100", "N", "ST", "", "", "", "")),
    ("9 #", ("9", "", "", "", "", "", "")),
    ("12", ("12", "", "", "", "", "", "")),
    ("no number here", ("", "", "", "", "", "", "")),
    ("", ("", "", "", "", "", "", "")),
    (None, ("", "", "", "", "", "", "")),
]


def test_addresses(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(ADDRESSES)], "k int, raw string")
    got = {r.k: r.a for r in df.select("k", text.address("raw").alias("a")).collect()}
    for k, (raw, want) in enumerate(ADDRESSES):
        assert tuple(got[k][c] for c in ("house", "predir", "street", "suffix", "postdir", "unit", "code")) == want, raw
    part = {raw: got[k] for k, (raw, _) in enumerate(ADDRESSES)}
    assert part["4616-6 WEST HOWARD LANE"].number == "4616" and part["100 W THOMAS P ECHOLS LN 3"].core == "THOMASPECHOLS"
    assert part["315 SHUKSAN WAY DWS4"].key == "315 SHUKSAN WAY" and part["no number here"].key == ""


def test_jaro_winkler():
    assert text.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert text.jaro_winkler_of("DWAYNE", "DUANE") == pytest.approx(0.84, abs=1e-4)
    assert text.jaro_winkler_of("AB", "AXYZQW") == pytest.approx(0.6)
    assert text.jaro_winkler_of("", "A") == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ABCDE", max_size=9), st.text("ABCDE", max_size=9))
def test_jaro_is_a_similarity(a, b):
    s = text.jaro_winkler_of(a, b)
    assert 0 <= s <= 1 + 1e-12
    assert (s > 1 - 1e-12) == (a == b and a != "") or a[:4] == b[:4]


def test_city_keys(spark):
    names = ["St. Paul", "SAINT PAUL", "City of Dallas", "Ft Worth", "Winston-Salem", None]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r.k for r in df.select(text.city_key(F.col("c")).alias("k")).collect()] == ["SAINT PAUL", "SAINT PAUL", "DALLAS", "FORT WORTH", "WINSTON SALEM", ""]
