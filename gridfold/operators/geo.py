"""Proximity joins on points: radius, nearest, sums over neighbours.

Pairs within a radius come from an equi-join on grid cells: one side is put into its cell, the other into the 3 x 3 cells
around it, and the exact distance decides. Cells are as high as the radius; their width grows with the band's latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.columns import RADIUS_COST, haversine
from gridfold.operators.storage import materialise, shared_dir

#: Sites up to which the nearest one is sought by a broadcast: distances per point then. More go by growing rings.
BROADCAST_SITES = 200
_SLACK = 1.001


def _band_width(band: Column, height: float) -> Column:
    """Degrees of longitude of a band's cells, by its edge farthest from the equator and a band of slack."""
    far = F.greatest(F.abs(band - 1), F.abs(band + 2)) * height
    return height / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.9), far))))


def radius_join(left: DataFrame, right: DataFrame, miles: float, *, a=("lat", "lon"), b=("site_lat", "site_lon"), radius: float = RADIUS_COST, distance: str = "miles", on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs at most so many miles apart (and equal in the columns on), with their distance. The right side is the one put into nine cells: give the smaller."""
    height = math.degrees(miles / radius) * _SLACK
    band = F.floor(F.col(a[0]) / height)
    own = left.withColumn("_band", band).withColumn("_cell", F.floor(F.col(a[1]) / _band_width(F.col("_band"), height)))
    bands = right.withColumn("_band", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.floor(F.col(b[0]) / height) + k)))
    turns = F.filter(F.array(*[F.lit(x) for x in (-360.0, 0.0, 360.0)]), lambda x: F.abs(F.col(b[1]) + x) <= 180 + 2 * _band_width(F.col("_band"), height))
    bands = bands.withColumn("_turn", F.explode(turns))
    centre = F.floor((F.col(b[1]) + F.col("_turn")) / _band_width(F.col("_band"), height))
    cells = bands.withColumn("_cell", F.explode(F.sequence(centre - 1, centre + 1))).drop("_turn")
    pairs = own.join(cells, ["_band", "_cell", *on]).withColumn(distance, haversine(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]), radius))
    return pairs.filter(F.col(distance) <= miles).drop("_band", "_cell")


#: Sites up to which all_pairs broadcasts them.
ALL_PAIRS_SITES = 20_000


def all_pairs(left: DataFrame, sites: DataFrame, *, broadcast_sites: int = ALL_PAIRS_SITES, radius: float = RADIUS_COST) -> DataFrame:
    """Every left row with every site and their distance, for sums over all sites. Few sites (counted) are broadcast, more are not."""
    few = sites.limit(broadcast_sites + 1).count() <= broadcast_sites
    return left.crossJoin(F.broadcast(sites) if few else sites).withColumn("miles", haversine("lat", "lon", "site_lat", "site_lon", radius))


def nearest(left: DataFrame, sites: DataFrame, site: str, *, other: Column | None = None, same: tuple[str, ...] = (), radius: float = RADIUS_COST, broadcast_sites: int = BROADCAST_SITES, first_miles: float = 10.0) -> DataFrame:
    """Each left row's nearest site (column site) and its distance; of equally near ones the smallest. Rows without any get nulls.

    other: a condition that a pair must meet, such as not the row's own site; same: the left's columns in it. Rows that
    agree in coordinates and these columns share one search.
    """
    keys = ["lat", "lon", *same]
    points = left.select(*keys).distinct()
    best = lambda pairs: pairs.groupBy(*keys).agg(F.min(F.struct("miles", site)).alias("_best")).select(*keys, F.col(f"_best.{site}").alias(site), F.col("_best.miles").alias("miles"))
    ok = F.lit(True) if other is None else other
    if sites.limit(broadcast_sites + 1).count() <= broadcast_sites:
        found = best(points.join(F.broadcast(sites), ok).withColumn("miles", haversine("lat", "lon", "site_lat", "site_lon", radius)))
    else:
        folder, whole = shared_dir(left.sparkSession, "nearest"), math.pi * radius
        points = rest = materialise(points.dropna(subset=["lat", "lon"]), f"{folder}/points")
        found, miles, step = None, min(first_miles, whole), 0
        while True:
            ring = materialise(best(radius_join(rest, sites, miles, radius=radius).filter(ok)), f"{folder}/{step}")
            found = ring if found is None else found.unionByName(ring)
            rest = points.join(found.select(*keys), keys, "left_anti")
            if miles >= whole or rest.isEmpty():
                break
            miles, step = min(8 * miles, whole), step + 1  # the last ring is the whole sphere
    return left.join(found, keys, "left")


def neighbour_sums(points: DataFrame, key: str, miles: float, weights: list[str], radius: float = RADIUS_COST) -> DataFrame:
    """Each point's sums of weights over all points within so many miles, itself included."""
    around = points.select(F.col(key).alias("_other"), F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), *[F.col(w).alias(f"_{w}") for w in weights])
    pairs = radius_join(points.select(key, "lat", "lon"), around, miles, radius=radius)
    return pairs.groupBy(key).agg(F.count("*").alias("neighbours"), *[F.sum(f"_{w}").alias(f"{w}_near") for w in weights])


def in_polygons(points: DataFrame, polygons: DataFrame, key: str, polygon: str) -> DataFrame:
    """Pairs of points and the polygons that hold them, by ray casting: polygons have vertices, an array of (lon, lat) in order.

    Boxes go by a grid of one degree first; a polygon's edges are then one array expression per candidate, without UDFs.
    """
    v = F.col("vertices")
    lons, lats = F.transform(v, lambda p: p["lon"]), F.transform(v, lambda p: p["lat"])
    boxes = polygons.select(polygon, v, F.array_min(lons).alias("min_lon"), F.array_max(lons).alias("max_lon"), F.array_min(lats).alias("min_lat"), F.array_max(lats).alias("max_lat"))
    cells = boxes.withColumn("_x", F.explode(F.sequence(F.floor("min_lon"), F.floor("max_lon")))).withColumn("_y", F.explode(F.sequence(F.floor("min_lat"), F.floor("max_lat"))))
    near = points.withColumns({"_x": F.floor("lon"), "_y": F.floor("lat")}).join(cells, ["_x", "_y"]).filter("lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat")
    turned = F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))
    edges = F.arrays_zip(v.alias("a"), turned.alias("b"))
    x, y = F.col("lon"), F.col("lat")
    crosses = lambda e: ((e["a"]["lat"] > y) != (e["b"]["lat"] > y)) & (x < (e["b"]["lon"] - e["a"]["lon"]) * (y - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"])
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return near.filter(inside).select(key, polygon)
