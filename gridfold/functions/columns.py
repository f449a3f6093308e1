"""Column expressions: codes, numbers, dates, great-circle distance, rates of change, weighted means, decay."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Earth radii in miles: cost and target work, and metro and coverage rules.
RADIUS_COST, RADIUS_METRO = 3958.8, 3958.7613


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zpad(code, width: int) -> Column:
    """Pads a code with zeros and never cuts it, unlike lpad. Null stays null."""
    code = _c(code).cast("string")
    return F.when(F.length(code) >= width, code).otherwise(F.lpad(code, width, "0"))


def number(text) -> Column:
    """A double, or null where the text is none. Thousands commas, blanks and dollar signs are dropped first."""
    return F.regexp_replace(F.trim(_c(text).cast("string")), r"[,$ ]", "").try_cast("double")


def number_flagged(text) -> tuple[Column, Column]:
    """The number, and whether a value was published that is none (a suppressed cell)."""
    value, raw = number(text), _c(text)
    return value, F.coalesce(value.isNull() & raw.isNotNull() & (F.trim(raw) != ""), F.lit(False))


def null_codes(value, codes: Sequence) -> Column:
    """Null for a publisher's substitute codes."""
    return F.when(_c(value).isin(list(codes)), F.lit(None)).otherwise(_c(value))


#: Spellings of truth values.
TRUE, FALSE = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")


def strict_boolean(value) -> Column:
    """True or false by a closed list of spellings; null or blank is false; anything else raises."""
    low = F.lower(F.trim(_c(value).cast("string")))
    return (
        F.when(low.isNull() | (low == ""), F.lit(False))
        .when(low.isin(*TRUE), F.lit(True))
        .when(low.isin(*FALSE), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), low)).cast("boolean"))
    )


def count_true(value) -> Column:
    return F.count_if(strict_boolean(value))


def quarter_index(year, quarter) -> Column:
    return _c(year) * 4 + _c(quarter) - 1


def quarter_id(year, quarter) -> Column:
    return F.concat(_c(year).cast("string"), F.lit("Q"), _c(quarter).cast("string"))


def quarter_start(year, quarter) -> Column:
    return F.make_date(_c(year).cast("int"), ((_c(quarter) - 1) * 3 + 1).cast("int"), F.lit(1))


def try_dates(text, formats: Sequence[str]) -> Column:
    """The first format that fits, as a date."""
    return F.coalesce(*[F.try_to_timestamp(_c(text), F.lit(f)) for f in formats]).cast("date")


def yoy(now, before) -> Column:
    """Percent change; null where the earlier value is missing or not positive."""
    now, before = _c(now), _c(before)
    return F.when(before > 0, 100.0 * (now - before) / before)


def haversine(lat1, lon1, lat2, lon2, radius: float = RADIUS_COST) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def closeness(lat1, lon1, lat2, lon2) -> Column:
    """Dot product of unit vectors: the cosine of the central angle, to compare with cos(miles / radius)."""
    a, b, x, y = (F.radians(_c(c)) for c in (lat1, lat2, lon1, lon2))
    return F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(x - y)


def within(cosine: Column, miles: float, radius: float = RADIUS_METRO) -> Column:
    return cosine >= math.cos(miles / radius)


def weighted_mean(value, weight) -> Column:
    """A missing value leaves the numerator only: its weight stays below."""
    return F.sum(_c(value) * _c(weight)) / F.nullif(F.sum(_c(weight)), F.lit(0))


def weighted_mean_complete(value, weight) -> Column:
    """Over rows with a value and a weight."""
    ok = _c(value).isNotNull() & _c(weight).isNotNull()
    return F.sum(F.when(ok, _c(value) * _c(weight))) / F.nullif(F.sum(F.when(ok, _c(weight))), F.lit(0))


def average_rank(by: Column, *partition: Column) -> Column:
    """Rank with ties averaged, 1 for the smallest."""
    ahead = Window.partitionBy(*partition).orderBy(by)
    ties = Window.partitionBy(*partition, by)
    return F.rank().over(ahead) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def percentile_rank(by: Column, *partition: Column) -> Column:
    """Average rank as a share of the group's rows."""
    return average_rank(by, *partition) / F.count(F.lit(1)).over(Window.partitionBy(*partition))


def half_distance(miles, c: float) -> Column:
    return c / (c + _c(miles))


def exponential_decay(miles, scale: float = 5.0) -> Column:
    return F.exp(-_c(miles) / scale)


def inverse_decay(miles, power: float = 1.0) -> Column:
    return 1 / F.pow(1 + _c(miles), F.lit(power))


def cloglog_hazard(eta) -> Column:
    """1 - exp(-exp(eta)), the exponent kept within 50."""
    return -F.expm1(-F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), _c(eta)))))


def cubic_spline(x, knots: Sequence[float]) -> list[Column]:
    """Restricted cubic spline basis: x, and a term per knot but the last two; linear beyond the outer knots."""
    x, last, before = _c(x).cast("double"), knots[-1], knots[-2]
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0))
    scale = (last - knots[0]) ** 2
    terms = [(cube(k) - cube(before) * ((last - k) / (last - before)) + cube(last) * ((before - k) / (last - before))) / scale for k in knots[:-2]]
    return [x, *terms]


def log1p_guarded(value) -> Column:
    return F.when(_c(value) >= 0, F.log1p(_c(value)))
