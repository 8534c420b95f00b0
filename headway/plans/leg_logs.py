"""Leg-log feeds: collapse repeated legs and rebuild trips.

Input rows are legs reported by a vehicle (origin stop -> destination stop with a
departure and an arrival time), often repeated while the vehicle waits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.scalars import safe_ratio
from ..operators import enrich, sequence

# Fixed values of the leg-log rules: shortest credible leg, longest stop-over inside a trip.
MIN_LEG_S = 30
TRIP_GAP_S = 15 * 60


def clean_legs(raw: DataFrame, vehicle: str, route: str, origin: str, dest: str, dep: str, arr: str) -> DataFrame:
    """Parse times (bad -> dropped, F3/N3), rename, trim ids (X9); empty ids are dropped,
    null ids pass (F5)."""
    d = raw.select(F.col(vehicle).cast("string").alias("vehicle_id"), F.col(route).cast("string").alias("route_id"),
                   F.trim(F.col(origin).cast("string")).alias("stop_id_origen"),
                   F.trim(F.col(dest).cast("string")).alias("stop_id_destino"),
                   F.try_to_timestamp(F.col(dep).cast("string")).alias("cikis_zaman"),
                   F.try_to_timestamp(F.col(arr).cast("string")).alias("varis_zaman"))
    d = d.dropna(subset=["cikis_zaman", "varis_zaman"])
    for c in ("stop_id_origen", "stop_id_destino"):
        d = d.where(F.col(c).isNull() | (F.col(c) != ""))
    return d.where(F.col("vehicle_id").isNotNull())


def collapse_repeats(legs: DataFrame, min_leg_s: float = MIN_LEG_S) -> DataFrame:
    """W6 + A3 + F4: contiguous rows of one vehicle with the same route, origin and
    destination become one leg (earliest departure, latest arrival); legs shorter than
    ``min_leg_s`` are dropped (exactly ``min_leg_s`` is kept)."""
    c = sequence.collapse_islands(legs, "vehicle_id", ["cikis_zaman", "varis_zaman", "stop_id_origen"],
                                  ["route_id", "stop_id_origen", "stop_id_destino"], "cikis_zaman", "varis_zaman",
                                  ["route_id", "stop_id_origen", "stop_id_destino"])
    base = (F.unix_micros("varis_zaman") - F.unix_micros("cikis_zaman")) / 1e6
    return c.withColumn("tiempo_viaje_base", base).where(F.col("tiempo_viaje_base") >= min_leg_s).drop("island", "n_rows")


def leg_features(legs: DataFrame, stops: DataFrame) -> DataFrame:
    """J3 (inner, both roles) + leg distance + W2 on leg speeds (distance / leg time of
    the 1..3 previous legs of the vehicle, missing -> 0)."""
    d = enrich.attach_od_stops(legs, stops, "stop_id_origen", "stop_id_destino")
    d = d.withColumn("distancia_base", haversine_m("o_stop_lat", "o_stop_lon", "d_stop_lat", "d_stop_lon"))
    d = d.where(F.col("distancia_base").isNotNull())
    d = d.withColumn("_speed", safe_ratio("distancia_base", "tiempo_viaje_base", fill=None))

    def lags(x, w, b):
        for j in (1, 2, 3):
            x = x.withColumn(f"vel_lag_{j}", F.coalesce(F.lag("_speed", j).over(w), F.lit(0.0)))
        return x

    return sequence.Seq(d, "vehicle_id", ["cikis_zaman", "varis_zaman", "stop_id_origen"]).run(lags, back=3).drop("_speed")


def rebuild_trips(legs: DataFrame, gap_s: float = TRIP_GAP_S) -> DataFrame:
    """A new trip starts at a vehicle's first leg, on a route change, when the
    departure is more than ``gap_s`` after the previous arrival, or when the origin is
    not the previous destination. ``trip_id`` = vehicle + running trip number."""
    d = (legs.withColumn("_dep_s", F.unix_micros("cikis_zaman") / 1e6)
             .withColumn("_arr_s", F.unix_micros("varis_zaman") / 1e6))
    d = sequence.island_ids(d, "vehicle_id", ["cikis_zaman", "varis_zaman", "stop_id_origen"], ["route_id"],
                            gap=(("_dep_s", "_arr_s"), gap_s), continuity=("stop_id_origen", "stop_id_destino"),
                            out="trip_no")
    return d.withColumn("trip_id", F.concat_ws("_", "vehicle_id", F.col("trip_no").cast("string"))).drop(
        "_dep_s", "_arr_s")
