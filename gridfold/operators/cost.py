"""Cost to serve a place: demand, tour geometry, and cost per stop and parcel under a set of parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostParameters:
    """Fixed values of the baseline; miles, hours, US dollars."""

    bhh_constant: float = 0.57
    stops_per_tour: float = 120
    circuity: float = 1.30
    van_mpg: float = 14.0
    maintenance_usd_per_mile: float = 0.19
    van_lease_usd_per_day: float = 41.0
    avg_speed_mph: float = 22.0
    service_minutes_per_stop: float = 2.4
    shift_hours: float = 9.0
    wage_loading: float = 1.32
    parcels_per_household_per_week: float = 3.2
    parcels_per_stop: float = 1.4
    income_elasticity: float = 0.35
    reference_income_usd: float = 75_000.0
    delivery_days_per_week: float = 6.0
    default_linehaul_miles: float = 25.0
    parcels_per_depot_per_day: float = 40_000.0

    def labour_usd_per_hour(self, wage: Column) -> Column:
        return wage * self.wage_loading / (self.shift_hours * self.delivery_days_per_week * 52.0)

    def distance_usd_per_mile(self, diesel: Column) -> Column:
        return diesel / self.van_mpg + self.maintenance_usd_per_mile


BASELINE = CostParameters()
#: One lever at a time, to show which assumption carries a result.
SCENARIOS = {
    "baseline": BASELINE,
    "slow_service": replace(BASELINE, service_minutes_per_stop=4.0),
    "single_parcel_stops": replace(BASELINE, parcels_per_stop=1.0),
    "dear_vans": replace(BASELINE, van_lease_usd_per_day=70.0),
    "short_tours": replace(BASELINE, stops_per_tour=90),
}


def evaluate(places: DataFrame, p: CostParameters = BASELINE) -> DataFrame:
    """Adds demand, distance and cost columns. Needs households, income, land, wage, diesel and linehaul (straight miles, may be null).

    A place without land area gets null densities and costs, as does one without households; a missing income counts as the
    reference income and is flagged.
    """
    c = F.col
    scale = F.pow(F.coalesce("income", F.lit(p.reference_income_usd)) / p.reference_income_usd, F.lit(p.income_elasticity))
    parcels = c("households") * p.parcels_per_household_per_week * scale / p.delivery_days_per_week
    steps = [
        {"daily_parcels": parcels, "income_imputed": c("income").isNull(), "linehaul_miles": F.coalesce(c("linehaul") * p.circuity, F.lit(p.default_linehaul_miles))},
        {"daily_stops": c("daily_parcels") / p.parcels_per_stop},
        {"stop_density": F.when((c("land") > 0) & (c("daily_stops") > 0), c("daily_stops") / c("land"))},
        {"local_miles": p.bhh_constant / F.sqrt("stop_density") * p.circuity, "line_miles": 2.0 * c("linehaul_miles") / p.stops_per_tour},
        {"miles_per_stop": c("local_miles") + c("line_miles"), "hourly": p.labour_usd_per_hour(c("wage"))},
        {
            "cost_distance": c("miles_per_stop") * p.distance_usd_per_mile(c("diesel")),
            "cost_drive_time": c("miles_per_stop") / p.avg_speed_mph * c("hourly"),
            "cost_service_time": p.service_minutes_per_stop / 60.0 * c("hourly"),
            "cost_vehicle": F.lit(p.van_lease_usd_per_day / p.stops_per_tour),
        },
        {"cost_per_stop": c("cost_distance") + c("cost_drive_time") + c("cost_service_time") + c("cost_vehicle"), "van_days": c("daily_stops") / p.stops_per_tour},
        {"cost_per_parcel": c("cost_per_stop") / p.parcels_per_stop, "daily_cost": c("cost_per_stop") * c("daily_stops"), "vans": F.ceil("van_days")},
    ]
    for step in steps:
        places = places.withColumns(step)
    return places.drop("hourly")


def sweep(places: DataFrame, scenarios: dict[str, CostParameters]) -> DataFrame:
    """Every place under every scenario, in one pass: parameters are columns of a broadcast row per scenario."""
    rows = places.sparkSession.createDataFrame([{"scenario": k, **{n: float(v) for n, v in asdict(p).items()}} for k, p in scenarios.items()])
    names = list(asdict(BASELINE))
    return evaluate(places.crossJoin(F.broadcast(rows)), CostParameters(**{n: F.col(n) for n in names})).drop(*names)


def fleet(costs: DataFrame) -> DataFrame:
    """Vans of a whole network: rounded up once, over the sum."""
    return costs.agg(F.ceil(F.sum("van_days")).alias("vans"))
