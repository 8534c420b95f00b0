"""Raw city inputs -> the visits frame consumed by ``city_etl``.

* ``pings_to_visits``: vehicle positions (epoch seconds) -> one visit per vehicle-minute
  (A4 first non-null per column, X7, P7 sentinel stop and default direction, N9 float32
  coordinates).
* ``arrivals_to_visits``: arrival CSV rows with 1900-epoch clocks (X5) joined to stop
  coordinates (J1).
* ``stop_times_to_visits``: GTFS stop_times with missing clocks interpolated by position
  (X3, W9), repaired stop coordinates (X6; a stop without them is no visit) and
  route/direction from trips (J2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import repair_coord
from ..functions.timefmt import clock_to_seconds, epoch1900_clock_to_instant
from ..operators import enrich, sequence
from ..operators.snap import snap_to_stops

# Fixed value: stop id used when a ping has none (the source's sentinel).
UNKNOWN_STOP = "SNAPPED_UNKNOWN"


def _f32(c):
    return F.col(c).cast("float").cast("double")


def pings_to_visits(pings: DataFrame, unit: str = "minute", stops: DataFrame | None = None,
                    snap_m: float = 100.0) -> DataFrame:
    """A4 + P7: the first ping of each vehicle and minute. A missing stop id is the nearest of ``stops``
    (stop_id, stop_lat, stop_lon) within ``snap_m`` metres (W13), else the sentinel."""
    p = pings.withColumn("_ts", F.timestamp_seconds(F.col("timestamp").cast("long")))
    if "direction_id" not in p.columns:
        p = p.withColumn("direction_id", F.lit("0"))
    tie = ["id"] if "id" in p.columns else []
    cols = ["route_id", "direction_id", "current_stop_id", "current_lat", "current_lon"]
    d = sequence.downsample_first(p, ["vehicle_id"], "_ts", unit, cols, tie)
    d = d.dropna(subset=["current_lat", "current_lon"])
    if stops is not None:
        d = snap_to_stops(d, stops, snap_m, "current_lat", "current_lon")
        d = d.withColumn("current_stop_id", F.coalesce(F.col("current_stop_id").cast("string"), "snapped_stop_id"))
    t_us = F.unix_micros("bin_ts")
    return d.select("vehicle_id", F.col("route_id").cast("string").alias("route_id"),
                    F.coalesce(F.col("direction_id").cast("string"), F.lit("0")).alias("direction_id"),
                    F.coalesce(F.col("current_stop_id").cast("string"), F.lit(UNKNOWN_STOP)).alias("stop_id"),
                    t_us.alias("seq"), t_us.alias("t_us"), _f32("current_lat").alias("lat"),
                    _f32("current_lon").alias("lon"))


def arrivals_to_visits(arrivals: DataFrame, stops: DataFrame, tz: str = "America/New_York") -> DataFrame:
    a = arrivals.withColumn("_inst", epoch1900_clock_to_instant(
        F.to_date(F.col("service_date")), F.try_to_timestamp(F.col("actual")), tz))
    a = a.where(F.col("_inst").isNotNull())
    s = stops.select("stop_id", _f32("stop_lat").alias("lat"), _f32("stop_lon").alias("lon"))
    a = enrich.attach_stops(a, s)
    return a.select("half_trip_id", "route_id", "direction_id", "stop_id",
                    F.col("time_point_order").cast("long").alias("seq"), F.unix_micros("_inst").alias("t_us"),
                    "lat", "lon")


def stop_times_to_visits(gtfs: dict, service_date: str = "1970-01-01") -> DataFrame:
    st = gtfs["stop_times"].select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("stop_sequence"),
                                   "arrival_time", clock_to_seconds("arrival_time").cast("double").alias("_sec"))
    st = sequence.interpolate_linear(st, "trip_id", ["stop_sequence", "stop_id", "arrival_time"], "_sec")
    st = st.where(F.col("_sec").isNotNull())
    stops = gtfs["stops"].select("stop_id", repair_coord("stop_lat").cast("float").cast("double").alias("lat"),
                                 repair_coord("stop_lon").cast("float").cast("double").alias("lon"))
    st = enrich.attach_stops(st, stops).dropna(subset=["lat", "lon"])
    st = enrich.attach_trips(st, gtfs["trips"])
    t_us = F.unix_micros(F.to_timestamp(F.lit(service_date))) + F.round(F.col("_sec") * 1e6).cast("long")
    return st.select("trip_id", "route_id", "direction_id", "stop_id", F.col("stop_sequence").cast("long").alias("seq"),
                     t_us.alias("t_us"), "lat", "lon")


def legs_to_visits(legs: DataFrame) -> DataFrame:
    """Leg rows (``leg_logs.leg_features`` + ``rebuild_trips``, or ``schedule.unroll_gtfs_legs``
    + ``scheduled_speed_lags``) -> visits for the leg-input cities: origin stop and departure as the visit, the leg's
    destination stop, arrival and coordinates as ``dest_*``, leg-speed lags carried."""
    has = set(legs.columns)
    lat_o = "o_stop_lat" if "o_stop_lat" in has else "lat_o"
    lon_o = "o_stop_lon" if "o_stop_lon" in has else "lon_o"
    lat_d = "d_stop_lat" if "d_stop_lat" in has else "lat_d"
    lon_d = "d_stop_lon" if "d_stop_lon" in has else "lon_d"
    trip = "trip_id" if "trip_id" in has else "trip_date_id"
    dep = F.unix_micros(F.col("cikis_zaman").cast("timestamp"))
    lags = ("vel_lag_1", "vel_lag_2", "vel_lag_3")
    if not has.issuperset(lags):
        raise ValueError("legs carry no speed lags; see leg_logs.leg_features or schedule.scheduled_speed_lags")
    lag_cols = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in lags]
    return legs.select(F.col(trip).alias("trip_id"), F.col("route_id").cast("string").alias("route_id"),
                       (F.col("direction_id") if "direction_id" in has else F.lit("0")).alias("direction_id"),
                       F.col("stop_id_origen").alias("stop_id"), dep.alias("seq"), dep.alias("t_us"),
                       F.col(lat_o).alias("lat"), F.col(lon_o).alias("lon"),
                       F.col("stop_id_destino").alias("dest_stop_id"),
                       F.unix_micros(F.col("varis_zaman").cast("timestamp")).alias("dest_t_us"),
                       F.col(lat_d).alias("dest_lat"), F.col(lon_d).alias("dest_lon"), *lag_cols)
