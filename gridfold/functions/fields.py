"""Fields of scanned tables: dates in words, floor areas, codes, states, and which column holds what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def text_date(text: Column) -> dict[str, Column]:
    """year, month, quarter and precision of a date in words; of several years the latest."""
    low = F.lower(F.coalesce(text, F.lit("")))
    years = F.transform(F.regexp_extract_all(low, F.lit(r"((?:19|20)\d\d)"), F.lit(1)), lambda y: y.cast("int"))
    year = F.array_max(years)
    word = F.regexp_extract(low, r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", 1)
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word), F.lit(0)).cast("int")
    named = F.regexp_extract(low, r"\bq([1-4])\b", 1).try_cast("int")
    quarter = F.coalesce(named, F.floor((month + 2) / 3).cast("int"))
    precision = F.when(year.isNull(), "none").when(month.isNotNull(), "month").when(quarter.isNotNull(), "quarter").otherwise("year")
    return {"year": year, "month": month, "quarter": quarter, "precision": precision}


def floor_area(text: Column) -> Column:
    """Square feet, with thousands commas or in millions."""
    number = F.regexp_replace(F.regexp_extract(text, r"([\d][\d,]*\.?\d*)", 1), ",", "").try_cast("double")
    return F.when(F.lower(text).rlike("million"), number * 1e6).otherwise(number)


def facility_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(text), r"\b([A-Z]{2,4}[0-9]{1,2})\b", 1), F.lit(""))


def repaired_state(text: Column, states: list[str]) -> Column:
    """A state's code after the usual misreadings (0 for O, 1 for I) are undone; null where it is none."""
    code = F.translate(F.upper(F.trim(text)), "01", "OI")
    return F.when(code.isin(states), code)


#: How a column's content shows what it holds.
CONTENT = {"code": r"^[A-Z]{2,4}[0-9]{1,2}$", "sqft": r"^[\d,]{5,}$", "date": r"(19|20)\d\d", "zip": r"\b\d{5}(-\d{4})?$", "state": r"^[A-Z]{2}$"}


def identify_columns(cells: DataFrame) -> dict[str, int]:
    """For a table's cells (column, text): which column is which kind; the best share first, each column and kind once."""
    scores = cells.groupBy("column").agg(*[F.avg(F.col("text").rlike(p).cast("double")).alias(k) for k, p in CONTENT.items()]).collect()
    ranked = sorted(((r[k], k, r["column"]) for r in scores for k in CONTENT if r[k]), key=lambda x: (-x[0], x[1], x[2]))
    out: dict[str, int] = {}
    for _, kind, column in ranked:
        if kind not in out and column not in out.values():
            out[kind] = column
    return out
