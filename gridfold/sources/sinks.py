"""Writers: parquet, CSV, and a stamped JSON file of small results."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition) if partition else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def stamped(results: dict, run_id: str | None = None) -> str:
    """JSON of small results with the run's id and time."""
    return json.dumps({"run_id": run_id or uuid.uuid4().hex, "written_at": datetime.datetime.now(datetime.UTC).isoformat(), **results}, default=str, sort_keys=True)
