from __future__ import annotations

import zipfile

import pytest

from gridfold.sources import readers, registry, sinks


def test_zipped_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("a.txt", "GEOID \tALAND\tINTPTLAT\n00601\t64.3\t18.18\n602\tx\t18.3\n".encode("latin-1"))
        z.writestr("b.txt", "GEOID \tALAND\tINTPTLAT\n00603\t31\t18.4\n")
    df = readers.zipped_table(spark, str(tmp_path / "g.zip"), ".txt", sep="\t", encoding="latin-1")
    out = readers.places(df.withColumnRenamed("geoid", "zcta"), "zcta", 5, ["aland"])
    assert sorted(map(tuple, out.collect())) == [("00601", 64.3), ("00602", None), ("00603", 31.0)]
    with pytest.raises(readers.SourceMissing):
        readers.zipped_table(spark, str(tmp_path / "g.zip"), "none")


def test_permits_keep_the_last(spark, tmp_path):
    names = ["survey_date", "state", "county", "u1_units", "u5_units"]
    (tmp_path / "1.txt").write_text("h\nh\n\n202101,1,3,5,1\n202102,1,3,9,\n")
    (tmp_path / "2.txt").write_text("h\nh\n\n202201,25,17,2,2\n")
    got = readers.permits(spark, [str(tmp_path / "1.txt"), str(tmp_path / "2.txt")], names)
    assert sorted(map(tuple, got.collect())) == [("01003", 2021, 9.0), ("25017", 2022, 4.0)]


def test_crosswalk_and_wide(spark):
    df = spark.createDataFrame([("1", "a", "5"), ("1", "b", "9"), ("", "c", "1"), ("2", "d", None)], "zcta string, county string, area string")
    assert {r.zcta: r.county for r in readers.crosswalk(df, "zcta", "county", "area").collect()} == {"1": "b", "2": "d"}
    wide = spark.createDataFrame([("1", "5", None, "7")], "zcta string, `2014-12` string, `2015-01-31` string, `2015-02` string")
    assert [(r.zcta, str(r.month), r.v) for r in readers.wide_months(wide, ["zcta"], "v", "2015-01-01").collect()] == [("1", "2015-02-01", 7.0)]


def test_json_rows_and_pages(spark):
    rows = [["NAME", "B19013", "zip"], ["x", "-666666666", "00601"], ["y", "52000", "00602"]]
    got = readers.json_rows(spark, rows, {"zip": "zcta", "B19013": "income"}, ["-666666666"], ["zcta"])
    assert sorted(map(tuple, got.collect()), key=str) == [("00601", None), ("00602", 52000.0)]
    data = [{"k": k} for k in range(12)]
    assert readers.paged(lambda lo, n: data[lo : lo + n], 12, 5) == data
    with pytest.raises(ValueError):
        readers.paged(lambda lo, n: data[lo : lo + n], 13, 5)


def test_energy_falls_back_to_the_country(spark):
    e = spark.createDataFrame([("MA", "2022-01", 20.0), ("ZZ", "2022-01", 9.0)], "state string, month string, price double")
    d = spark.createDataFrame([("R1", "2022-01", 4.0), ("US", "2022-01", 3.5)], "region string, month string, diesel double")
    got = {r.state: (r.diesel, r.diesel_grain) for r in readers.energy(e, d, {"MA": "R1"}).collect()}
    assert got == {"MA": (4.0, "region"), "ZZ": (3.5, "country")}


def test_aliases_and_stack(spark):
    df = spark.createDataFrame([("a", 1)], "ID string, POP int")
    assert readers.resolve(df, {"tract": ["geoid", "id"], "pop": ["pop"]}).columns == ["tract", "pop"]
    with pytest.raises(KeyError):
        readers.resolve(df, {"x": ["nope"]})
    assert readers.stacked({2017: df, 2018: df.drop("POP")}, [2017, 2018]).count() == 2
    with pytest.raises(readers.SourceMissing):
        readers.stacked({2017: df}, [2019])


def test_ocr(spark):
    words = [(1, "FC", 90.0, 10, 10, 20), (1, "FC", 50.0, 12, 11, 20), (1, "BFI4", 80.0, 120, 10, 30), (1, "SC", 70.0, 10, 71, 20), (1, "low", 5.0, 10, 71, 20)]
    df = spark.createDataFrame(words, "page int, text string, conf double, left long, top long, width long")
    grid = readers.ocr_grid(readers.ocr_words(df)).collect()
    assert sorted((r.row, r.column, r.text) for r in grid) == [(0, 0, "FC"), (0, 1, "BFI4"), (1, 0, "SC")]


def test_registry(spark, tmp_path):
    assert registry.get("gazetteer").required and registry.by_availability("manual")
    with pytest.raises(KeyError):
        registry.get("nope")
    report = registry.build(spark, {"gazetteer": lambda s: s.range(3), "home_value": lambda s: s.read.parquet("/nowhere/x")}, str(tmp_path))
    assert report["gazetteer"] == "written" and report["home_value"].startswith("absent")
    assert len(registry.summary()) == len(registry.SOURCES)
    sinks.write_csv(spark.range(2), str(tmp_path / "csv"))
    assert '"run_id": "r"' in sinks.stamped({"x": 1}, "r")


def test_fetch_caches_and_retries(tmp_path):
    from gridfold.sources.http import fetch

    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("once")
        return b"zip bytes", "application/zip"

    path = fetch("http://x/a.zip", str(tmp_path), expect="zip", wait=0, opener=opener)
    assert path.read_bytes() == b"zip bytes" and fetch("http://x/a.zip", str(tmp_path), opener=opener) == path and len(calls) == 2
    with pytest.raises(ValueError):
        fetch("http://x/b.zip", str(tmp_path), expect="zip", opener=lambda u, t: (b"<html>", "text/html"))
    assert len((tmp_path / "manifest.jsonl").read_text().splitlines()) == 1


def test_workbooks(spark, tmp_path):
    from gridfold.sources import excel

    rows = [["Title"], ["code", None, " name ", "n"], ["00601", "x", "a & <b>", 7], [None, None, "c", 1.5], ["é", None, None, None]]
    (tmp_path / "a.xlsx").write_bytes(excel.workbook(rows))
    got = excel.excel(spark, str(tmp_path / "a.xlsx"), header=1)
    assert got.columns == ["code", "name", "n"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("00601", "a & <b>", "7"), (None, "c", "1.5"), ("é", None, None)], key=str)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/One.XLSX", excel.workbook([["k"], *[[i] for i in range(6000)]], "Data & more"))
    assert excel.excel(spark, str(tmp_path / "a.zip"), member="one.xlsx", sheet="Data & more").agg({"k": "count"}).first()[0] == 6000
    with pytest.raises(Exception, match="no member"):
        excel.excel(spark, str(tmp_path / "a.zip"), member="two.xlsx")
    with pytest.raises(readers.SourceMissing):
        excel.excel(spark, str(tmp_path / "a.xlsx"), header=9)
    wide = excel.workbook([[f"c{k}" for k in range(30)], list(range(30))])
    assert next(r for at, r in excel.cells_of(wide) if at == 1)[26] == "26"
