"""Nearest sites on the sphere through a grid of cells.

Points become unit vectors, and a vector lies in a cell of a cube around the sphere, so poles and the date line are places
like any other. Cells of units and cells of sites are paired from coarse to fine: a pair is kept if the site cell can hold a site
that is at least as near as one that some other cell is sure to hold. Only the sites of the cells left at the finest level are
measured. Pairs belong to cells, not to units, so units that are close share the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditloom.functions import geo
from creditloom.session import cut_lineage

# Bits of a cell number per axis, level by level. The finest cells measure about 400 m.
LEVELS = (4, 8, 12, 15)
_AXES = ("x", "y", "z")


def _points(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct places (lat, lon) with the finest cell of each, written: every level reads them again."""
    radius = 1 << (LEVELS[-1] - 1)
    a, b = F.radians("lat"), F.radians("lon")
    vector = (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
    cells = [F.least(F.floor((v + 1) * radius), F.lit(2 * radius - 1)).cast("int").alias(axis) for v, axis in zip(vector, _AXES)]
    places = df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropna().distinct()
    return cut_lineage(places.where("lat = lat and not isnan(lat) and not isnan(lon)").select("lat", "lon", *cells))


def _cells(points: DataFrame, level: int, name: str) -> DataFrame:
    """Distinct cells of a level, as columns name + axis."""
    shift = LEVELS[-1] - level
    return points.select(*[F.shiftright(axis, shift).alias(name + axis) for axis in _AXES]).distinct()


def _inside(child: str, parent: str, bits: int) -> Column:
    """Whether a cell lies in a coarser one."""
    return reduce(lambda a, b: a & b, [F.shiftright(child + axis, bits) == F.col(parent + axis) for axis in _AXES])


def _nearest_cells(units: DataFrame, sites: DataFrame) -> DataFrame:
    """(ux, uy, uz, sx, sy, sz): for each finest cell of units, the cells that may hold the nearest site of one of them."""
    # All cells lie in one of level 0; a level has a few hundred occupied ones in each cell of the one before.
    whole = [F.lit(0).alias(side + axis) for side in "us" for axis in _AXES]
    pairs, before = units.sparkSession.range(1).select(*whole), 0
    per_cell = Window.partitionBy("ux", "uy", "uz")
    # Distances in cells of the level: the least between two boxes, and the most to any point of the site's.
    steps = [F.abs(F.col("u" + axis) - F.col("s" + axis)).cast("long") for axis in _AXES]
    least = reduce(lambda a, b: a + b, [F.greatest(d - 1, F.lit(0)) * F.greatest(d - 1, F.lit(0)) for d in steps])
    most = reduce(lambda a, b: a + b, [(d + 1) * (d + 1) for d in steps])
    for level in LEVELS:
        bits = level - before
        of_units, of_sites = _cells(units, level, "u"), _cells(sites, level, "s")
        coarse = pairs.toDF(*[f"p{c}" for c in pairs.columns])
        joined = coarse.join(of_units, _inside("u", "pu", bits)).join(of_sites, _inside("s", "ps", bits))
        found = joined.select("ux", "uy", "uz", "sx", "sy", "sz", least.alias("__least"), most.alias("__most"))
        pairs = found.withColumn("__bound", F.min("__most").over(per_cell)).where("__least <= __bound")
        pairs, before = pairs.select("ux", "uy", "uz", "sx", "sy", "sz"), level
    return pairs


def min_distance(
    units: DataFrame,
    sites: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    name: str = "distance_min",
) -> DataFrame:
    """Distance of every unit to its nearest site in km; NULL without sites or without a place.

    Exact: a site is only left out if another one is sure to be at least as near. Distances are worked out once per
    distinct place and joined back; the largest cosine belongs to the nearest site, so the angle is taken once per place.
    """
    places, targets = _points(units, lat, lon), _points(sites, lat, lon)
    near = _nearest_cells(places, targets)
    u = places.toDF("u_lat", "u_lon", "ux", "uy", "uz")
    s = targets.toDF("s_lat", "s_lon", "sx", "sy", "sz")
    measured = near.join(u, ["ux", "uy", "uz"]).join(s, ["sx", "sy", "sz"])
    closest = measured.groupBy("u_lat", "u_lon").agg(F.max(geo.cosine(F.col("u_lat"), F.col("u_lon"), F.col("s_lat"), F.col("s_lon"))).alias("__closest"))
    same = (F.col(lat).cast("double") == F.col("u_lat")) & (F.col(lon).cast("double") == F.col("u_lon"))
    distance = F.when(F.col("__closest").isNotNull(), geo.km_of_cosine(F.col("__closest")))
    return units.join(closest, same, "left").withColumn(name, distance).select(*units.columns, name)
