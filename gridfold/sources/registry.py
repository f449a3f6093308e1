"""The declared sources: what each holds, its grain, and whether a build can do without it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    name: str
    grain: tuple[str, ...]
    available: str  # "open", "key" or "manual"
    required: bool = True
    note: str = ""


SOURCES = {
    s.name: s
    for s in (
        Source("gazetteer", ("zcta",), "open"),
        Source("cbp", ("zcta",), "open"),
        Source("building_permits", ("county_geoid", "year"), "open"),
        Source("zcta_county", ("zcta",), "open"),
        Source("cbsa_county", ("county_geoid",), "open"),
        Source("rent_index", ("zcta", "month"), "open"),
        Source("home_value", ("zcta", "month"), "open", False),
        Source("wages", ("area_code", "occ_code"), "open", False),
        Source("exposure", ("tract_geoid",), "open", False),
        Source("energy", ("state", "month"), "key"),
        Source("household_survey", ("zcta",), "key"),
        Source("cbp_detail", ("zcta", "cbp_year"), "open", False),
        Source("inspections", ("activity_nr",), "open", False),
        Source("facilities", ("facility_id",), "manual"),
    )
}

Builder = Callable[[SparkSession], DataFrame]


def get(name: str) -> Source:
    if name not in SOURCES:
        raise KeyError(f"{name}: not among {sorted(SOURCES)}")
    return SOURCES[name]


def by_availability(kind: str) -> list[Source]:
    return [s for s in SOURCES.values() if s.available == kind]


def summary() -> list[dict]:
    return [{"name": s.name, "grain": ", ".join(s.grain), "available": s.available, "required": s.required} for s in SOURCES.values()]


def build(spark: SparkSession, builders: dict[str, Builder], folder: str) -> dict[str, str]:
    """Runs every builder and writes its table; a required source that fails stops the build, another is reported."""
    report = {}
    for name, make in builders.items():
        try:
            make(spark).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
            report[name] = "written"
        except Exception as e:
            if get(name).required:
                raise
            report[name] = f"absent: {type(e).__name__}"
    return report
