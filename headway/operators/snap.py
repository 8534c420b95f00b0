"""Nearest-stop snap (W13): positions to the closest stop within a radius.

A grid of latitude bands, each cut into its own number of longitude cells, so that a cell
is at least as wide and as high as the search radius everywhere: a point's stops lie in its
own cell or a neighbour of it (three bands, three cells each; cells wrap at the date
line, and a band that touches a pole's circle is one cell). The stops are written into every
cell from which they can be seen, a list per cell, and positions look up one cell with one
equi-join: rows are neither multiplied nor grouped, and nothing but the distance
decides. Stops at one place are one candidate (the smallest id).

Crowded cells are cut finer: where a list is longer than ``MAX_CELL_STOPS``, grids of half
the radius, a quarter and so on come first. A stop found within a smaller radius is the
nearest one, so a position goes on to the next wider grid only while it has found none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m
from .enrich import checked_broadcast

#: Longest list of stops that is searched as it is.
MAX_CELL_STOPS = 64
#: Narrowest search radius.
MIN_RADIUS_M = 2.0


class Grid:
    """Cells for searches within ``radius_m``."""

    def __init__(self, radius_m: float):
        # A little wider than the radius, against rounding.
        self.angle = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
        self.bands = max(1, math.floor(180.0 / self.angle))

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90.0) * (self.bands / 180.0)), F.lit(self.bands - 1)).cast("long")

    def cells(self, band: Column) -> Column:
        """Longitude cells of a band: as wide as the radius reaches from the band's edge nearest to a pole."""
        height = 180.0 / self.bands
        edge = F.greatest(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0))
        reach = F.degrees(F.asin(F.sin(F.radians(F.lit(self.angle))) / F.cos(F.radians(edge))))
        return F.when(edge + self.angle >= 90.0, F.lit(1)).otherwise(F.greatest(F.floor(360.0 / (reach * (1 + 1e-9))), F.lit(1))).cast("long")

    def cell(self, lon: Column, band: Column) -> Column:
        n = self.cells(band)
        turn = F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) / 360.0
        return F.least(F.floor(turn * n), n - 1).cast("long")

    def seen_from(self, lat: Column, lon: Column) -> Column:
        """All (band, cell) from whose points a place may be within the radius."""
        here = self.band(lat)
        bands = F.filter(F.array(here - 1, here, here + 1), lambda b: (b >= 0) & (b < self.bands))

        def around(b):
            n, c = self.cells(b), self.cell(lon, b)
            return F.transform(F.array_distinct(F.array(F.pmod(c - 1, n), c, F.pmod(c + 1, n))),
                               lambda x: F.struct(b.alias("band"), x.alias("cell")))
        return F.flatten(F.transform(bands, around))


def stop_places(stops: DataFrame, stop_id: str = "stop_id", lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    """(stop_id, lat, lon): one row a place, with its smallest stop id; stops without coordinates are left out."""
    s = stops.select(F.col(stop_id).alias("stop_id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    s = s.where(F.col("lat").between(-90, 90) & F.col("lon").isNotNull() & ~F.isnan("lon"))
    return s.groupBy("lat", "lon").agg(F.min("stop_id").alias("stop_id")).select("stop_id", "lat", "lon")


def cell_lists(places: DataFrame, grid: Grid) -> DataFrame:
    """(band, cell, stops): the stops that can be seen from each cell."""
    at = places.withColumn("at", F.explode(grid.seen_from(F.col("lat"), F.col("lon"))))
    return at.groupBy(F.col("at.band").alias("band"), F.col("at.cell").alias("cell")).agg(
        F.collect_list(F.struct("stop_id", "lat", "lon")).alias("stops"))


def search_radii(places: DataFrame, radius_m: float, max_cell_stops: int) -> list[float]:
    """Radii from the narrowest to ``radius_m``: halved until no list is longer than ``max_cell_stops``."""
    radii = [float(radius_m)]
    while radii[0] / 2 >= MIN_RADIUS_M:
        longest = cell_lists(places, Grid(radii[0])).agg(F.max(F.size("stops"))).first()[0]
        if (longest or 0) <= max_cell_stops:
            break
        radii.insert(0, radii[0] / 2)
    return radii


def snap_to_stops(positions: DataFrame, stops: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon",
                  stop_id: str = "stop_id", stop_lat: str = "stop_lat", stop_lon: str = "stop_lon",
                  out: str = "snapped_stop_id", max_cell_stops: int = MAX_CELL_STOPS) -> DataFrame:
    """Adds ``out`` (nearest stop within ``radius_m``, null without one; the smaller id of equally
    near stops) and ``snap_m`` (its distance). A position without coordinates has none."""
    places = stop_places(stops, stop_id, stop_lat, stop_lon)
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    known = y.between(-90, 90) & x.isNotNull() & ~F.isnan(x)
    d = positions.withColumn("_hit", F.lit(None).cast(f"struct<m:double,stop_id:{places.schema['stop_id'].dataType.simpleString()}>"))
    for r in search_radii(places, radius_m, max_cell_stops):
        grid = Grid(r)
        lists = cell_lists(places, grid).withColumnsRenamed({"band": "_band", "cell": "_cell", "stops": "_stops"})
        seek = known & F.col("_hit").isNull()
        # Positions that have their stop look up no cell; their keys are spread over the tasks.
        idle = F.pmod(F.xxhash64(lat, lon), F.lit(1 << 16))
        d = d.withColumn("_band", F.when(seek, grid.band(y)).otherwise(-1)).withColumn(
            "_cell", F.when(seek, grid.cell(x, grid.band(y))).otherwise(idle))
        d = d.join(checked_broadcast(lists), ["_band", "_cell"], "left")
        near = F.array_min(F.transform("_stops", lambda s: F.struct(
            haversine_m(y, x, s["lat"], s["lon"]).alias("m"), s["stop_id"].alias("stop_id"))))
        d = d.withColumn("_near", near).withColumn("_hit", F.coalesce("_hit", F.when(F.col("_near.m") <= r, F.col("_near"))))
        d = d.drop("_near", "_stops", "_band", "_cell")
    return d.withColumn(out, F.col("_hit.stop_id")).withColumn("snap_m", F.col("_hit.m")).drop("_hit")
