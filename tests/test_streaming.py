from __future__ import annotations

import datetime

from gridfold.streaming import windows


def test_windows_close_and_late_rows_go(spark, tmp_path):
    schema = "ts timestamp, kind string, value double"
    day = lambda d, h=1: datetime.datetime(2024, 1, d, h)
    for k, rows in enumerate([[(day(1), "a", 1.0), (day(1, 2), "a", 2.0)], [(day(3), "a", 5.0)], [(day(1, 3), "a", 100.0), (day(6), "a", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(source / f"{k}-{f.name}")
    events = windows.read_events(spark, str(source), schema)
    q = windows.upsert_panel(windows.windowed(events, "ts", ["kind"], "value"), str(tmp_path / "out"), str(tmp_path / "check"), ["kind"])
    q.awaitTermination(120)
    got = {str(r.start)[:10]: r.total for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] in (3.0, 103.0) and got["2024-01-03"] == 5.0
