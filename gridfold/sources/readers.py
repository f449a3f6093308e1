"""Readers of published files: typed tables from zipped text, headerless multi-file CSV, crosswalks, wide series and JSON rows.

A zip is unpacked by the tasks (binaryFiles), so an archive of any store that Spark reads will do; lines then go through
Spark's CSV parser. Codes are strings of fixed width, measures doubles; what is no number becomes null.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.functions.columns import number, number_flagged, zpad
from gridfold.functions.ordered import first_by


class SourceMissing(FileNotFoundError):
    """A required source is not there."""


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet table that must be there; columns, if given, are all that is scanned."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceMissing(path) from e
        raise
    return df.select(*columns) if columns else df


def zip_lines(spark: SparkSession, path: str, member: str = "", encoding: str = "utf-8", skip: int = 0) -> DataFrame:
    """The lines of a zip's members whose names contain `member`: file, member, line_no, line. A byte order mark goes."""
    schema = "file string, member string, line_no long, line string"

    def run(batches: Iterable) -> Iterable:
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if member not in name or name.endswith("/"):
                            continue
                        with z.open(name) as raw:
                            rows = []
                            for k, line in enumerate(io.TextIOWrapper(raw, encoding=encoding, newline=None)):
                                if k >= skip:
                                    rows.append((file, name, k, line.rstrip("\r\n").lstrip("﻿")))
                                if len(rows) == 20_000:
                                    yield pd.DataFrame(rows, columns=["file", "member", "line_no", "line"])
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=["file", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def delimited(lines: DataFrame, names: Sequence[str], sep: str = ",", line: str = "line") -> DataFrame:
    """Lines parsed as CSV into string columns of the given names."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return lines.withColumn("_r", F.from_csv(line, schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "mode": "PERMISSIVE"})).select(*[c for c in lines.columns if c != line], "_r.*")


def zipped_table(spark: SparkSession, path: str, member: str = "", sep: str = ",", encoding: str = "utf-8", skip: int = 0) -> DataFrame:
    """A zipped text table with a header; names are stripped and put in lower case. Headers repeated in later members go."""
    lines = zip_lines(spark, path, member, encoding, skip)
    head = lines.orderBy("member", "line_no").select("line").first()
    if head is None:
        raise SourceMissing(f"{path}: no member like {member!r}")
    names = [n.strip().strip('"').lower() for n in head.line.split(sep)]
    return delimited(lines.filter(F.col("line") != head.line), names, sep).drop("file", "member", "line_no")


def resolve(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns under their own names: of each name's candidates the first that the table has."""
    have = {c.lower(): c for c in df.columns}
    found = {}
    for name, candidates in aliases.items():
        hit = next((have[c.lower()] for c in candidates if c.lower() in have), None)
        if hit is None:
            raise KeyError(f"{name}: none of {list(candidates)}")
        found[name] = hit
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def by_prefix(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns found by how their names begin."""
    return df.select(*[F.col(f"`{next(c for c in df.columns if c.lower().startswith(p.lower()))}`").alias(n) for n, p in names.items()])


def places(df: DataFrame, key: str, width: int = 5, measures: Sequence[str] = ()) -> DataFrame:
    """A place table: a padded key, numeric measures."""
    return df.select(zpad(F.trim(key), width).alias(key), *[number(m).alias(m) for m in measures])


def permits(spark: SparkSession, paths: Sequence[str], names: Sequence[str], skip: int = 3) -> DataFrame:
    """Yearly headerless files: county code from two parts, units summed over *_units columns, the last row of a county and year kept."""
    parts = []
    for k, path in enumerate(paths):
        lines = spark.read.text(path, wholetext=False).withColumn("_n", F.monotonically_increasing_id()).withColumn("_file", F.lit(k))
        ordered = lines.withColumn("_k", F.row_number().over(_by_file())).filter(F.col("_k") > skip)
        parts.append(delimited(ordered.withColumnRenamed("value", "line"), names))
    rows = reduce(DataFrame.unionByName, parts)
    units = [c for c in names if c.endswith("_units")]
    total = reduce(lambda a, b: a + b, [F.coalesce(number(c), F.lit(0.0)) for c in units])
    out = rows.select(F.concat(zpad(F.trim("state"), 2), zpad(F.trim("county"), 3)).alias("county_geoid"), F.floor(number("survey_date") / 100).cast("int").alias("year"), total.alias("units"), "_file", "_k")
    return first_by(out, ["county_geoid", "year"], F.desc("_file"), F.desc("_k")).drop("_file", "_k")


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("_file").orderBy("_n")


def crosswalk(df: DataFrame, key: str, other: str, share: str) -> DataFrame:
    """For each key the counterpart with the largest share, ties by its code."""
    rows = df.filter(F.col(key).isNotNull() & (F.trim(key) != "")).withColumn(share, number(share))
    return first_by(rows, [key], F.desc_nulls_last(share), F.col(other))


def wide_months(df: DataFrame, ids: Sequence[str], value: str, since: str = "0000-00-00") -> DataFrame:
    """One column per month to one row per month: columns named YYYY-MM[-DD] from `since` on; nulls go."""
    months = [c for c in df.columns if len(c) in (7, 10) and c[:4].isdigit() and c[4] == "-" and c >= since[: len(c)]]
    long = df.select(*ids, *[number(f"`{m}`").alias(m) for m in months]).unpivot(list(ids), months, "month", value)
    month = F.when(F.length("month") == 7, F.concat("month", F.lit("-01"))).otherwise(F.col("month"))
    return long.filter(F.col(value).isNotNull()).withColumn("month", F.to_date(month)).withColumn("year", F.year("month"))


def wages(df: DataFrame, codes: Sequence[str], area: str = "area", occupation: str = "occ_code", wage: str = "a_mean") -> DataFrame:
    """Rows of the given occupations, with suppressed cells flagged."""
    value, suppressed = number_flagged(wage)
    return df.filter(F.col(occupation).isin(list(codes))).select(area, occupation, value.alias("annual_mean_wage"), suppressed.alias("wage_suppressed"))


def last_wins_pivot(df: DataFrame, key: str, code: str, value: str, codes: Mapping[str, str], order: str) -> DataFrame:
    """A column per code; of several rows of a key and code the last counts."""
    rows = first_by(df.filter(F.col(code).isin(list(codes))), [key, code], F.desc(order))
    return rows.groupBy(key).pivot(code, list(codes)).agg(F.first(number(value))).withColumnsRenamed(dict(codes))


def json_rows(spark: SparkSession, rows: Sequence[Sequence], rename: Mapping[str, str], sentinels: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """A service's answer, [header, *rows] of strings: renamed columns, numbers but for keys, substitute codes as null."""
    head, *body = rows
    df = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in body], T.StructType([T.StructField(h, T.StringType()) for h in head]))
    cell = lambda h, n: F.col(h).alias(n) if n in keys else number(F.when(F.col(h).isin(list(sentinels)), None).otherwise(F.col(h))).alias(n)
    return df.select(*[cell(h, n) for h, n in rename.items()])


def paged(fetch: Callable[[int, int], Sequence[Mapping]], total: int, page: int = 5000) -> list[Mapping]:
    """All rows of a paged service; raises where the pages don't add up to the total."""
    out: list[Mapping] = []
    while len(out) < total:
        got = fetch(len(out), page)
        if not got:
            break
        out += got
    if len(out) != total:
        raise ValueError(f"{len(out)} of {total} rows")
    return out


def energy(electricity: DataFrame, diesel: DataFrame, regions: Mapping[str, str]) -> DataFrame:
    """State and month: price of electricity, and of diesel by the state's region, else the country's."""
    spark = electricity.sparkSession
    of = F.broadcast(spark.createDataFrame(list(regions.items()), "state string, region string"))
    d = diesel.select(F.col("region"), "month", F.col("diesel").alias("own"))
    us = diesel.filter("region = 'US'").select("month", F.col("diesel").alias("country"))
    out = electricity.join(of, "state", "left").join(d, ["region", "month"], "left").join(us, "month", "left")
    return out.withColumn("diesel", F.coalesce("own", "country")).withColumn("diesel_grain", F.when(F.col("own").isNotNull(), "region").when(F.col("country").isNotNull(), "country")).drop("own", "country")


def keyword_lines(lines: DataFrame, pattern: str, names: Sequence[str], field: str, exact: str, sep: str = ",") -> DataFrame:
    """Raw lines are screened by a pattern before they are parsed; the field then decides."""
    return delimited(lines.filter(F.col("line").rlike(pattern)), names, sep).filter(F.col(field).rlike(exact))


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def ocr_words(df: DataFrame, confidence: float = 25.0, near: int = 6) -> DataFrame:
    """Words of scanned tables: confident ones, of overlapping copies (equal text within so many pixels) the more confident."""
    words = df.filter((F.col("conf") >= confidence) & (F.trim("text") != ""))

    def dedupe(rows):
        rows = rows.sort_values(["conf", "top", "left"], ascending=[False, True, True])
        kept: dict[str, list[tuple[int, int]]] = {}
        keep = []
        for t, x, y in zip(rows["text"], rows["left"], rows["top"], strict=True):
            own = kept.setdefault(t, [])
            free = all(abs(x - a) > near or abs(y - b) > near for a, b in own)
            keep.append(free)
            if free:
                own.append((x, y))
        return rows[keep]

    return words.groupBy("page").applyInPandas(dedupe, words.schema)


def ocr_grid(words: DataFrame, gap: int = 25, pitch: int = 20) -> DataFrame:
    """Words of each page in table cells: page, row, column, text. Columns are split at gutters without words, rows where tops jump."""

    def grid(rows):
        import numpy as np
        import pandas as pd

        span = np.zeros(int((rows["left"] + rows["width"]).max()) + gap + 2, int)
        np.add.at(span, rows["left"].to_numpy(), 1)
        np.add.at(span, (rows["left"] + rows["width"]).to_numpy() + 1, -1)
        busy = np.cumsum(span) > 0
        edges, free = [0], 0
        for x, b in enumerate(busy):
            if b and free >= gap and x > rows["left"].min():
                edges.append(x)
            free = 0 if b else free + 1
        tops = np.sort(rows["top"].unique())
        starts = tops[np.concatenate([[True], np.diff(tops) > pitch])]
        cells = rows.assign(row=np.searchsorted(starts, rows["top"], "right") - 1, column=np.searchsorted(edges, rows["left"], "right") - 1).sort_values(["row", "column", "top", "left"])
        out = cells.groupby(["row", "column"], as_index=False)["text"].agg(" ".join)
        return pd.DataFrame({"page": rows["page"].iloc[0], "row": out["row"], "column": out["column"], "text": out["text"]})

    return words.select("page", "left", "top", "width", "text").groupBy("page").applyInPandas(grid, "page int, row long, column long, text string")


def stacked(tables: Mapping[int, DataFrame], allowed: Sequence[int], name: str = "vintage") -> DataFrame:
    """Yearly tables on the allow-list, by column name, with their year."""
    if missing := [v for v in allowed if v not in tables]:
        raise SourceMissing(f"vintages {missing}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tables[v].withColumn(name, F.lit(v)) for v in allowed])


def retailer(name: Column, yes: str, no: str, industry: Column, prefix: str) -> Column:
    """A telling name, else not a namesake, else the industry's code."""
    return F.when(name.rlike(yes), True).when(name.rlike(no), False).otherwise(F.coalesce(industry.startswith(prefix), F.lit(False)))
