"""Schedule composites: calendar unroll into legs (C1) and schedule x days expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.timefmt import clock_to_seconds, date_plus_clock, parse_yyyymmdd
from ..operators import enrich, sequence, splits
from ..session import materialize


def first_service_day(calendar: DataFrame) -> Column:
    """Earliest ``start_date`` of the calendar as a scalar subquery (no driver collect)."""
    return calendar.agg(F.min(parse_yyyymmdd("start_date"))).scalar()


def unroll_gtfs_legs(gtfs: dict[str, DataFrame], start: str | Column | None = None, days: int = 8,
                     min_leg_s: float = 0.0, n_lags: int = 0) -> DataFrame:
    """Simulate ``days`` days (start .. start+days-1, the source's 8) of a GTFS
    bundle and return one row per scheduled leg between consecutive stops of a
    simulated trip (``trip_id + '_' + yyyyMMdd``):

    J7 active services -> J8 trips and stop_times -> X3/X4 clocks past 24 h -> J1 stop
    coordinates -> W8 next stop (last stop dropped) -> F4 leg time > ``min_leg_s``; with ``n_lags`` the
    result is that of ``scheduled_speed_lags`` on those legs.

    A trip has the same legs on every day, so they (and their lags) are made once a trip and then
    dealt to its days. Only a trip id that ``trips`` or its service's days hold more than once, whose simulated trip
    mixes the rows of its copies, is unrolled to days first."""
    cal = gtfs["calendar"]
    start_col = first_service_day(cal) if start is None else start
    active = materialize(_active(cal, start_col, days), "active")
    trips = gtfs["trips"].select("route_id", "service_id", "trip_id",
                                 F.coalesce(F.col("direction_id"), F.lit("0")).alias("direction_id"))
    st = gtfs["stop_times"].select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("stop_sequence"),
                                   clock_to_seconds("departure_time").alias("_dep"), clock_to_seconds("arrival_time").alias("_arr"))
    stops = gtfs["stops"].select("stop_id", F.col("stop_lat").try_cast("double").alias("lat"),
                                 F.col("stop_lon").try_cast("double").alias("lon"))
    twice = active.groupBy("service_id", "service_date").count().where("count > 1").select("service_id").distinct()
    many = trips.join(enrich.checked_broadcast(twice), "service_id", "left_semi").select("trip_id").unionByName(
        trips.groupBy("trip_id").count().where("count > 1").select("trip_id"))
    many = materialize(many.where("trip_id IS NOT NULL").distinct(), "copies")

    def legs_of(visits: DataFrame, entity: str, date) -> DataFrame:
        v = enrich.attach_stops(visits, stops).withColumns({"cikis_zaman": date_plus_clock(date, "_dep"),
                                                            "llegada": date_plus_clock(date, "_arr")})
        # ties in stop_sequence (malformed feeds) are broken by departure, then stop id
        legs = sequence.next_leg(v, entity, ["stop_sequence", "cikis_zaman", "stop_id"],
                                 ["stop_id", "llegada", "_arr", "lat", "lon"], prefix="d_", counted=visits)
        base = (F.unix_micros(F.col("d_llegada").cast("timestamp")) - F.unix_micros(F.col("cikis_zaman").cast("timestamp"))) / 1e6
        legs = legs.withColumn("tiempo_viaje_base", base).where(F.col("tiempo_viaje_base") > min_leg_s)
        legs = legs.withColumnsRenamed({"stop_id": "stop_id_origen", "d_stop_id": "stop_id_destino", "d_llegada": "varis_zaman",
                                        "lat": "lat_o", "lon": "lon_o", "d_lat": "lat_d", "d_lon": "lon_d"})
        return scheduled_speed_lags(legs, n_lags, entity, visits) if n_lags else legs

    def shaped(legs: DataFrame) -> DataFrame:
        return legs.select("trip_date_id", "route_id", "direction_id", "stop_id_origen", "stop_id_destino", "cikis_zaman",
                           "varis_zaman", "lat_o", "lon_o", "lat_d", "lon_d", "tiempo_viaje_base",
                           *(["distancia_base", *[f"vel_lag_{j}" for j in range(1, n_lags + 1)]] if n_lags else []))

    copies = many.limit(1).count() > 0
    once = trips.join(many, "trip_id", "left_anti") if copies else trips
    # the clocks of a day that stands for all; the legs' own days follow
    legs = legs_of(st, "trip_id", F.lit("1970-01-01")).join(once, "trip_id").drop("cikis_zaman", "varis_zaman")
    legs = legs.withColumnRenamed("d__arr", "_to")
    legs = enrich.unroll_calendar(active, legs)
    out = shaped(legs.withColumns({"cikis_zaman": date_plus_clock("service_date", "_dep"),
                                   "varis_zaman": date_plus_clock("service_date", "_to")}))
    if not copies:
        return out
    u = enrich.unroll_calendar(active, trips.join(many, "trip_id", "left_semi"), st)
    return out.unionByName(shaped(legs_of(u, "trip_date_id", "service_date")))


def scheduled_speed_lags(legs: DataFrame, n: int = 3, entity: str = "trip_date_id",
                         counted: DataFrame | None = None) -> DataFrame:
    """Legs of ``unroll_gtfs_legs`` with ``vel_lag_1..n``: the scheduled speeds (distance /
    leg time) of the 1..n previous legs of the simulated trip in order of departure, 0.0
    where there is none. Legs without a distance are dropped first; a speed over a zero
    leg time counts as missing. Equal departures are ordered by arrival and stops.
    ``counted``: see ``sequence.Seq``."""
    dist = haversine_m("lat_o", "lon_o", "lat_d", "lon_d").cast("float").cast("double")
    d = legs.withColumn("distancia_base", dist).where(F.col("distancia_base").isNotNull())
    d = d.withColumn("_speed", F.try_divide("distancia_base", "tiempo_viaje_base"))

    def fn(rows, w, branch):
        for j in range(1, n + 1):
            rows = rows.withColumn(f"vel_lag_{j}", F.coalesce(F.lag("_speed", j).over(w).cast("float").cast("double"), F.lit(0.0)))
        return rows

    order = ["cikis_zaman", "varis_zaman", "stop_id_origen", "stop_id_destino"]
    return sequence.Seq(d, [entity], order, counted=counted).run(fn, back=n).drop("_speed")


def _active(cal: DataFrame, start: str | Column, days: int) -> DataFrame:
    if isinstance(start, str):
        return enrich.active_service_days(cal, start, days)
    d0 = start
    flags = F.array(*[F.col(w).try_cast("int") for w in enrich.WEEKDAYS])
    ex = cal.select("service_id", parse_yyyymmdd("start_date").alias("_s"), parse_yyyymmdd("end_date").alias("_e"),
                    flags.alias("_f"), F.explode(F.sequence(d0, F.date_add(d0, days - 1))).alias("service_date"))
    return ex.where(F.col("service_date").between(F.col("_s"), F.col("_e"))
                    & (F.get(F.col("_f"), F.weekday("service_date")) == 1)).select("service_id", "service_date")


def expand_schedule(gtfs: dict[str, DataFrame], start: str, days: int, n_trips: int | None = None,
                    seed: int = 42) -> DataFrame:
    """C2 without the noise model: (optionally) ``n_trips`` trips chosen by a seeded
    hash (T9), clocks parsed strictly (X2 raises on bad values), stop coordinates (J1)
    with missing coordinates dropped (F9), route/direction from trips (J2), and one copy
    per simulated day (J16). Output: scheduled pings (vehicle = trip, timestamp)."""
    st = gtfs["stop_times"]
    if n_trips is not None:
        st = splits.sample_entities(st, "trip_id", n_trips, seed)
    st = st.withColumn("_sec", clock_to_seconds("arrival_time", on_error="raise"))
    stops = gtfs["stops"].select("stop_id", F.col("stop_lat").try_cast("double").alias("current_lat"),
                                 F.col("stop_lon").try_cast("double").alias("current_lon"))
    st = enrich.attach_stops(st, stops).dropna(subset=["current_lat", "current_lon"])
    st = enrich.attach_trips(st, gtfs["trips"])
    st = enrich.replicate_days(st, start, days)
    ts = date_plus_clock("service_date", "_sec")
    return st.select(F.col("trip_id").alias("vehicle_id"), "route_id", "direction_id",
                     F.col("stop_id").alias("current_stop_id"), "current_lat", "current_lon",
                     F.unix_seconds(ts.cast("timestamp")).alias("timestamp"))
