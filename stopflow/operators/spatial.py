"""Range joins on coordinates and proximity clusters.

Theta conditions on distance become equi-joins on grid cells, so work follows local density. The
grid holds at every latitude and across the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell, cells_around, grid_cell, haversine_m
from ..session import cut_lineage
from .ordered import top_per_key


def _around(y: Column, x: Column) -> Column:
    """Array of the 3 by 3 cells around a cell."""
    return F.flatten(F.transform(F.sequence(y - 1, y + 1), lambda a: F.transform(F.sequence(x - 1, x + 1), lambda b: F.struct(a.alias("_cy"), b.alias("_cx")))))


def _spread(stations: DataFrame, key: str, metres: float) -> DataFrame:
    """Stations copied into every cell that a point within the radius may lie in."""
    return stations.select(F.col(key).alias("_station"), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"),
                           F.inline(cells_around("lat", "lon", metres)))


def _near(points: DataFrame, stations: DataFrame, station_key: str, metres: float) -> DataFrame:
    near = _spread(stations, station_key, metres)
    keyed = points.withColumn("_p", grid_cell("lat", "lon", metres))
    pairs = keyed.join(near, (F.col("_p._cy") == F.col("_cy")) & (F.col("_p._cx") == F.col("_cx")))
    return (pairs.withColumn("distance_m", haversine_m("lat", "lon", "_slat", "_slon"))
            .filter(F.col("distance_m") <= metres).drop("_p", "_cy", "_cx"))


def _rings(spots: DataFrame, k: int, metres: float, crowd: int = 16) -> list[float]:
    """Radii to search one after another, the last being ``metres``: halved until the most crowded cell holds about ``crowd`` times k."""
    cells = spots.groupBy(grid_cell("lat", "lon", metres).alias("_cell")).agg(F.count("*").alias("n"))
    most = cells.agg(F.max("n")).first()[0] or 0
    halvings = max(0, math.ceil(math.log2(max(1.0, most / (crowd * k))) / 2))  # a quarter of the stations per halving
    return [metres / 2 ** i for i in range(min(halvings, 12), -1, -1)]


def nearest_stations(points: DataFrame, stations: DataFrame, point_key: str, station_key: str, k: int = 3,
                     metres: float = 2000) -> DataFrame:
    """The k nearest stations within a radius. Stations at one spot are first cut to the k smallest keys.

    Where stations lie densely the radius is opened in rings: a point that finds k stations within a ring is done, as nothing outside
    can be nearer, and only the others go on to the next ring of twice the radius. So a point in a dense place meets some
    k stations instead of all within ``metres``; how many rings there are follows the most crowded cell. Each ring is written down.
    """
    spots = top_per_key(stations.select(station_key, "lat", "lon"), ["lat", "lon"], [F.col(station_key).asc()], k, "_r").drop("_r")
    rings = _rings(spots, k, metres)
    left, found = points.select(point_key, "lat", "lon"), None
    for ring in rings:
        pairs = _near(left, spots, station_key, ring)
        ranked = top_per_key(pairs, [point_key], [F.col("distance_m").asc(), F.col("_station").asc()], k)
        ranked = ranked.select(point_key, F.col("_station").alias(station_key), "distance_m", "rank")
        if ring < metres:
            full = ranked.groupBy(point_key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select(point_key)
            ranked = cut_lineage(ranked.join(full, point_key, "left_semi"))
            left = cut_lineage(left.join(ranked.select(point_key).distinct(), point_key, "left_anti"))
        found = ranked if found is None else found.unionByName(ranked)
    return found


def near_any_station(points: DataFrame, stations: DataFrame, metres: float = 500) -> DataFrame:
    """Points with any station within the radius. Equal station spots count once."""
    spots = stations.select("lat", "lon").distinct().withColumn("_spot", F.lit(1))
    near = _spread(spots, "_spot", metres)
    at = grid_cell("lat", "lon", metres)
    cond = ((at["_cy"] == F.col("_cy")) & (at["_cx"] == F.col("_cx")) & (haversine_m("lat", "lon", "_slat", "_slon") <= metres))
    return points.join(near, cond, "left_semi")


def proximity_clusters(points: DataFrame, key: str, threshold: float = 0.0005, salts: int = 8) -> DataFrame:
    """Greedy clusters: in key order, each free point seeds a cluster and takes all free points within
    ``threshold`` degrees on both axes. Returns each point with its seed.

    Points of one grid cell are all close to each other, so a cell can offer only its earliest free
    point. In every round a cell's candidate becomes a seed when no neighbouring candidate is
    earlier and still free; points close to a seed then stop being free. That gives the sequential
    result in as many rounds as the longest chain of earlier neighbours. Per round only one row per
    cell is compared, and points meet at most nine seeds; hot cells are split by salt.
    """
    y, x = cell("lat", threshold), cell("lon", threshold)
    base = points.select(F.col(key).alias("id"), "lat", "lon", y.alias("cy"), x.alias("cx"),
                         F.pmod(F.xxhash64(key), F.lit(salts)).alias("salt"))
    base = cut_lineage(base)
    free, seeds = base, None
    while True:
        first = free.groupBy("cy", "cx").agg(F.min_by(F.struct("id", "lat", "lon"), "id").alias("c"))
        offers = first.select("cy", "cx", "c.*")
        shown = offers.select(F.col("id").alias("_other"), F.inline(_around(F.col("cy"), F.col("cx"))))
        earliest = shown.groupBy("_cy", "_cx").agg(F.min("_other").alias("_min"))
        fresh = offers.join(earliest, (F.col("cy") == F.col("_cy")) & (F.col("cx") == F.col("_cx"))).filter(
            F.col("id") == F.col("_min")).select("id", "lat", "lon", "cy", "cx")
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            break
        seeds = fresh if seeds is None else seeds.unionByName(fresh)
        near = _close_to(free, fresh, threshold, salts).select(F.col("id").alias("_taken")).distinct()
        free = cut_lineage(free.join(near, F.col("id") == F.col("_taken"), "left_anti"))
    owners = _close_to(base, seeds, threshold, salts).groupBy("id").agg(F.min("_seed").alias("seed"))
    return base.select("id", "lat", "lon").join(owners, "id").withColumnRenamed("id", key)


def _close_to(points: DataFrame, seeds: DataFrame, threshold: float, salts: int) -> DataFrame:
    spread = seeds.select(F.col("id").alias("_seed"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
                          F.inline(_around(F.col("cy"), F.col("cx"))))
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = ((F.col("cy") == F.col("_cy")) & (F.col("cx") == F.col("_cx")) & (F.col("salt") == F.col("_salt"))
            & (F.abs(F.col("lat") - F.col("_lat")) < threshold) & (F.abs(F.col("lon") - F.col("_lon")) < threshold)
            & (F.col("_seed") <= F.col("id")))
    return points.join(spread, cond)


def cluster_centres(members: DataFrame, key: str) -> DataFrame:
    """Size, mean position and earliest member per cluster."""
    return members.groupBy("seed").agg(F.count("*").alias("n_members"), F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"))
