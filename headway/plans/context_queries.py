"""Driver queries for joins, calendars, metrics, scalar parsing and comparisons.

Role mappings (fixed, shared with ``context_oracles``):
* ``lineitem`` rows are stop arrivals: stop = ``l_suppkey``, line = ``l_partkey % 10``,
  arrival date = ``l_shipdate``; ``supplier`` is the stop dimension (distance =
  ``s_acctbal / 1000`` km); ``orders`` rows are passenger-flow records.
* ``nation`` rows are GTFS services, ``orders`` rows are trips of the customer's
  nation service.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scalars, timefmt
from ..operators import enrich, metrics, sequence, splits
from ..session import scratch_path
from . import event_queries as EQ
from .city_inputs import UNKNOWN_STOP
from .events_model import ORDER, r4, read_table, stop_events

ENTITY = "user_id"
K_MODEL_EVENTS = 3          # model horizon for the chained-inference demonstration
LOCAL_TZ = "America/New_York"

# Public holidays of Massachusetts in the event month (S13 input).
HOLIDAYS_US_MA_2024_01 = [("US-MA", "2024-01-01"), ("US-MA", "2024-01-15")]


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# ---------------------------------------------------------------------------
# joins
# ---------------------------------------------------------------------------
def q_dim_join_roles(spark: SparkSession, sf: str) -> DataFrame:
    """The nation dimension in two roles (customer's and supplier's nation)."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    d = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
           .join(enrich.checked_broadcast(s), li.l_suppkey == s.s_suppkey))
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation"))
    d = d.join(enrich.checked_broadcast(cn), "c_nationkey").join(enrich.checked_broadcast(sn), "s_nationkey")
    return d.select("l_orderkey", "l_linenumber", "cust_nation", "supp_nation")


def q_baseline_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each arrival gets the previous year's mean quantity for its
    (returnflag, linestatus) context; the first year has none -> 0."""
    li = _t(spark, sf, "lineitem").withColumn("yr", F.year("l_shipdate"))
    base = (li.groupBy("l_returnflag", "l_linestatus", "yr")
              .agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("baseline_qty"))
              .withColumn("yr", F.col("yr") + 1))
    d = enrich.attach_baseline(li, base, ["l_returnflag", "l_linestatus", "yr"], "baseline_qty")
    return d.select("l_orderkey", "l_linenumber", r4("baseline_qty").alias("baseline_qty"))


def _hourly_weather(ev: DataFrame) -> DataFrame:
    """Hourly 'weather' derived from the events: max reading and a count-based rate."""
    return (ev.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour_key"))
              .agg(F.max("value").alias("temperature_2m"), (F.count(F.lit(1)) / 10.0).alias("precipitation")))


def q_weather_hour_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each event joins the weather of the previous UTC hour; hours without
    weather keep a null temperature and 0 precipitation."""
    ev = stop_events(spark, sf)
    w = _hourly_weather(ev)
    d = enrich.attach_weather_hour(ev.withColumn("_prev", F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 HOUR")),
                                   w, "_prev", None, True, ("temperature_2m", "precipitation"),
                                   fill={"precipitation": 0.0})
    return d.select("event_id", "temperature_2m", "precipitation")


def _calendar_from_nation(spark, sf) -> DataFrame:
    """nation -> GTFS calendar rows: weekday flags and a 21-day validity as yyyyMMdd."""
    n = _t(spark, sf, "nation")
    flags = [F.when(F.pmod(F.col("n_nationkey") + i, F.lit(3)) != 0, "1").otherwise("0").alias(w)
             for i, w in enumerate(enrich.WEEKDAYS)]
    start = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("n_nationkey"), F.lit(10)))
    return n.select(F.col("n_nationkey").alias("service_id"), *flags,
                    F.date_format(start, "yyyyMMdd").alias("start_date"),
                    F.date_format(F.date_add(start, 20), "yyyyMMdd").alias("end_date"))


def q_calendar_unroll(spark: SparkSession, sf: str) -> DataFrame:
    """8 simulated days from 2024-01-08; each order (trip) runs on the
    days its customer's nation service is active."""
    active = enrich.active_service_days(_calendar_from_nation(spark, sf), "2024-01-08", 8)
    trips = (_t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .select(F.col("o_orderkey").alias("trip_id"), F.col("c_nationkey").alias("service_id")))
    u = enrich.unroll_calendar(active, trips)
    return u.select("trip_date_id", F.col("trip_id").alias("o_orderkey"),
                    F.date_format("service_date", "yyyy-MM-dd").alias("service_date"))


def q_holiday_flag(spark: SparkSession, sf: str) -> DataFrame:
    """J9 with naive wall time relabelled as the date (no zone conversion)."""
    from ..sources.readers import holidays_table
    ev = stop_events(spark, sf)
    d = enrich.holiday_flag(ev, holidays_table(spark, HOLIDAYS_US_MA_2024_01), "ts", None)
    return d.select("event_id", "is_holiday")


def q_calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    """P8 + J9 on local New York time of the (UTC) event instant."""
    from ..sources.readers import holidays_table
    ev = stop_events(spark, sf).withColumn("ts_utc", F.col("ts").cast("timestamp"))
    d = enrich.holiday_flag(ev, holidays_table(spark, HOLIDAYS_US_MA_2024_01), "ts_utc", LOCAL_TZ)
    cal = [c.cast("long").alias(n) for c, n in zip(timefmt.calendar_features("ts_utc", LOCAL_TZ),
                                                   ("hora_del_dia", "dia_semana", "mes"))]
    return d.select("event_id", *cal, "is_holiday")


# ---------------------------------------------------------------------------
# metrics over a closed-form predictor (hist average)
# ---------------------------------------------------------------------------
def _scored_pairs(spark, sf, unbounded=False) -> DataFrame:
    ev = stop_events(spark, sf)
    p = EQ.unbounded_pairs(ev) if unbounded else EQ.bounded_pairs(ev)
    return EQ.with_hist(p)


def q_metrics_global(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.regression_metrics(_scored_pairs(spark, sf), "tt", "hist_avg")
    return m.select(F.col("n").cast("long").alias("n"), r4("mae").alias("mae"), r4("rmse").alias("rmse"),
                    r4("r2").alias("r2"))


def q_metrics_by_k(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.metrics_by_horizon(_scored_pairs(spark, sf, True), "tt", "hist_avg", "k", K_MODEL_EVENTS)
    return m.select(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), r4("mae").alias("mae"),
                    r4("rmse").alias("rmse"), r4("r2").alias("r2"), r4("share").alias("share"), "mode")


def q_mape_nonzero(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.mape_nonzero(_scored_pairs(spark, sf), "tt", "hist_avg")
    return m.select(r4("mape").alias("mape"), F.col("n_nonzero").cast("long").alias("n_nonzero"))


def closed_form_eta(hops, hist):
    """Stand-in regressor used where a fitted model is not the point: 30 s per sqrt(hop)
    plus 0.9 of the historical time."""
    h = F.col(hops) if isinstance(hops, str) else hops
    t = F.col(hist) if isinstance(hist, str) else hist
    return F.lit(30.0) * F.sqrt(h.cast("double")) + F.lit(0.9) * t


def q_chained_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """Horizons above the model's K are split into balanced segments, each
    predicted with hops = segment and the historical time scaled by segment/k, summed."""
    from ..ml.chained import predict_chained
    p = _scored_pairs(spark, sf, True)

    def model(df):
        return df.withColumn("prediction", closed_form_eta("num_paradas_salto", "tiempo_promedio_historico"))

    feats = p.select("o_event_id", "d_event_id", "k", F.col("k").cast("double").alias("num_paradas_salto"),
                     F.col("hist_avg").alias("tiempo_promedio_historico"))
    out = predict_chained(model, feats, ["o_event_id", "d_event_id"], K_MODEL_EVENTS)
    return out.select("o_event_id", "d_event_id", F.col("k").cast("long").alias("k"),
                      F.col("n_segments").cast("long").alias("n_segments"), r4("prediction").alias("yhat"))


# ---------------------------------------------------------------------------
# scalar functions on strings built from ids
# ---------------------------------------------------------------------------
def q_confidence_score(spark: SparkSession, sf: str) -> DataFrame:
    ev = stop_events(spark, sf)
    d = sequence.next_leg(ev, ENTITY, ORDER, ["t_us"], keep_last=True)
    eta = (F.col("next_t_us") - F.col("t_us")) / 1e6
    return d.select("event_id", scalars.confidence(F.hour("ts"), F.weekday("ts"), eta,
                                                    F.col("value") / 10.0, F.col("value") / 20.0).alias("confidence"))


def _clock_strings(ev: DataFrame) -> DataFrame:
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.col("event_id") % 30, F.col("event_id") % 60, F.col("user_id") % 60
    txt = (F.when(F.col("event_id") % 11 == 0, F.concat_ws(":", h.cast("string"), m.cast("string")))
            .when(F.col("event_id") % 13 == 0, F.concat(F.lit("xx:"), pad(m), F.lit(":00")))
            .otherwise(F.concat_ws(":", pad(h), pad(m), pad(s))))
    return ev.withColumn("clock", txt)


def q_gtfs_time_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = _clock_strings(stop_events(spark, sf))
    return d.select("event_id", "clock", timefmt.clock_to_seconds("clock").alias("seconds"))


def q_coord_repair(spark: SparkSession, sf: str) -> DataFrame:
    ev = stop_events(spark, sf)
    base = (F.lit(410000) + F.col("event_id") % 9973).cast("string")
    raw = (F.when(F.col("event_id") % 13 == 0, F.lit("4"))
            .when(F.col("event_id") % 7 == 0, F.concat(F.lit("41."), (F.col("event_id") % 1000).cast("string"),
                                                       F.lit("."), (F.col("event_id") % 97).cast("string")))
            .when(F.col("event_id") % 5 == 0, F.concat(F.lit("-"), base))
            .otherwise(base))
    d = ev.withColumn("raw", raw)
    return d.select("event_id", "raw", geo.repair_coord("raw").alias("coord"))


def q_props_json(spark: SparkSession, sf: str) -> DataFrame:
    ev = stop_events(spark, sf)
    return ev.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("prop_k"))


def q_polyline_points(spark: SparkSession, sf: str) -> DataFrame:
    """A14 as rows: every user's points in order (the ordered list without collecting
    a whole group into one array)."""
    ev = stop_events(spark, sf)
    d = sequence.ordered_points(ev, ENTITY, ORDER, ["lat", "lon"])
    return d.select(ENTITY, F.col("point_seq").cast("long").alias("point_seq"), "lat", "lon")


def q_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """A13 on coordinates in 1e-4 degree units (exact integer sums, so the mean does
    not depend on summation order)."""
    ev = stop_events(spark, sf).select(ENTITY, F.round(F.col("lat") * 10000).cast("long").alias("lat_e4"),
                                       F.round(F.col("lon") * 10000).cast("long").alias("lon_e4"))
    c = sequence.centroid(ev, ENTITY, "lat_e4", "lon_e4")
    return c.select(ENTITY, r4(F.col("center_lat") / 10000.0).alias("center_lat"),
                    r4(F.col("center_lon") / 10000.0).alias("center_lon"))


# ---------------------------------------------------------------------------
# M9 comparison, legs, reports
# ---------------------------------------------------------------------------
SCHEDULE_GRID_US = 300 * 1_000_000
MIN_PRED_S = 30.0


def q_schedule_vs_model(spark: SparkSession, sf: str) -> DataFrame:
    """Scheduled time from a 5-minute timetable grid (distance at
    15 km/h when the grid difference is not positive), model = historical time floored
    at 30 s, errors in minutes, improvement % and winner."""
    from ..plans.compare import compare_schedule_model
    p = _scored_pairs(spark, sf)
    grid = lambda c: F.floor(F.col(c) / SCHEDULE_GRID_US) * SCHEDULE_GRID_US
    p = p.withColumn("sched_diff_s", (grid("d_t_us") - grid("o_t_us")) / 1e6)
    c = compare_schedule_model(p, "sched_diff_s", "dist_m", "tt", "hist_avg", "k", MIN_PRED_S)
    return c.select("o_event_id", "d_event_id", F.col("hops").cast("long").alias("hops"),
                    r4("sched_s").alias("sched_s"), r4("predicted_s").alias("predicted_s"),
                    r4("error_sched_min").alias("error_sched_min"), r4("error_model_min").alias("error_model_min"),
                    r4("improvement_pct").alias("improvement_pct"), "model_wins")


def q_od_pairs_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Leg input (§2.7.2): rows are legs (event -> next event); k pairs leg i's origin
    with leg i+k's destination, so k = 1 already spans two hops."""
    from .events_model import K_EVENTS, MAX_TT_EVENTS_S
    ev = stop_events(spark, sf)
    legs = sequence.next_leg(ev, ENTITY, ORDER, ["event_id", "t_us"])
    p = sequence.lookahead_pairs(legs, ENTITY, ORDER, ["event_id", "t_us"], ["next_event_id", "next_t_us"],
                                 K_EVENTS, leg_input=True)
    tt = (F.col("d_next_t_us") - F.col("o_t_us")) / 1e6
    p = p.withColumn("tt", tt).where((F.col("tt") > 0) & (F.col("tt") <= MAX_TT_EVENTS_S))
    return p.select("o_event_id", F.col("d_next_event_id").alias("d_event_id"),
                    F.col("k").cast("long").alias("k"), "tt")


def q_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Null counts of the gappy reading table (long form)."""
    ev = EQ._gappy(stop_events(spark, sf))
    return metrics.null_counts(ev, ["event_id", "user_id", "stop_id", "v"]).select(
        "column_name", F.col("n_null").cast("long").alias("n_null"))


def q_quality_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, missing readings and non-zero speed lags of both date splits."""
    from .events_model import SPLIT_CUTOFF
    d = sequence.speed_lags(EQ._gappy(stop_events(spark, sf)), ENTITY, ORDER, "lat", "lon", "t")
    return metrics.quality_by_split(splits.split_date(d, "ts", SPLIT_CUTOFF), ["v", "stop_id"], ["vel_lag_1", "vel_lag_3"])


def q_ids_and_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """X7 + X9 + X16 + X17: trimmed ids (blank is null), labels, local wall time and second of the day."""
    ev = stop_events(spark, sf)
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    local = timefmt.epoch_seconds_to_local(F.floor(F.col("t_us") / 1e6).cast("long"), LOCAL_TZ)
    return ev.select("event_id", scalars.clean_id(raw).alias("vehicle_id"),
                     scalars.route_label(F.col("route_id").cast("string"), F.col("stop_id")).alias("label"),
                     F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"),
                     timefmt.seconds_of_day(local).cast("long").alias("second_of_day"))


def q_tables_on_disk(spark: SparkSession, sf: str) -> DataFrame:
    """K2 + K7 + R7: events appended to a dated table in two halves, old dates dropped on reading,
    and the rest written and read by split."""
    from ..session import scratch_path
    from ..sources import sinks
    from ..streaming.feed import drop_old_partitions
    log, by_split = scratch_path(spark, "pings"), scratch_path(spark, "splits")
    ev = stop_events(spark, sf).select("event_id", "ts", F.to_date("ts").alias("event_date"))
    for half in splits.complement(ev.withColumn("_late", F.col("event_id") % 2 == 1), "_late"):
        sinks.append_table(half.drop("_late"), log, ["event_date"])
    kept = drop_old_partitions(spark.read.parquet(log), "2024-01-08")
    sinks.write_splits(splits.split_date(kept, "ts", "2024-01-21"), by_split)
    return spark.read.parquet(by_split).select("event_id", F.col("event_date").cast("string").alias("event_date"),
                                               F.col("split").cast("string").alias("split"))


def q_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A9 + A1: distinct entities, stops and user-days; time range."""
    ev = stop_events(spark, sf)
    return ev.agg(F.countDistinct(ENTITY).alias("n_users"), F.countDistinct("stop_id").alias("n_stops"),
                  F.countDistinct(ENTITY, F.to_date("ts")).alias("n_user_days"),
                  F.min("t_us").alias("min_t_us"), F.max("t_us").alias("max_t_us"))


# ---------------------------------------------------------------------------
# flat ETLs (C4, C5) over lineitem / supplier / orders
# ---------------------------------------------------------------------------
def _arrivals(spark, sf) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_suppkey").alias("stop_id"), (F.col("l_partkey") % 10).alias("line_id"),
        F.col("l_returnflag").alias("traffic_level"), F.col("l_linestatus").alias("weather_condition"),
        F.weekday("l_shipdate").alias("day_of_week"), F.col("l_shipdate").alias("actual_arrival"),
        (F.col("l_tax") * 100).alias("cumulative_delay_min"), (F.col("l_discount") * 100).alias("delay_min"),
        F.col("l_quantity").alias("passengers_waiting"),
        (F.col("l_linenumber") % 3).alias("hour_of_day"), F.concat("l_linestatus", "l_returnflag").alias("stop_type"),
        # leakage columns present in the raw feed
        F.col("l_extendedprice").alias("passengers_boarding"), F.col("l_discount").alias("dwell_time_min"))


def q_delay_features(spark: SparkSession, sf: str) -> DataFrame:
    """C4: arrivals left-join stop distance (no dedupe), drop incomplete rows, float32
    features, date split train < 2000-01-01 <= test < 2001-01-01."""
    from .flat_etl import delay_features
    sup = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("stop_id"),
                                           (F.col("s_acctbal") / 1000.0).alias("distance_from_prev_km"))
    d = delay_features(_arrivals(spark, sf), sup, "actual_arrival", "2000-01-01", "2001-01-01")
    return d.select("l_orderkey", "l_linenumber", "distance_from_prev_km", "delay_min", "split")


def q_crowd_features(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals left-join a deduplicated passenger-flow baseline (first record per
    context wins, missing -> 0), leakage columns dropped, split with no upper bound."""
    from .flat_etl import crowd_features
    o = _t(spark, sf, "orders")
    flow = o.select((F.col("o_custkey") % 50).alias("stop_id"), (F.col("o_orderkey") % 10).alias("line_id"),
                    (F.col("o_custkey") % 3).alias("hour_of_day"),
                    F.weekday("o_orderdate").alias("day_of_week"),
                    F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("weather_condition"),
                    (F.col("o_totalprice") / 1000.0).alias("avg_passengers_waiting"), "o_orderkey")
    arr = _arrivals(spark, sf).withColumn("stop_id", F.col("stop_id") % 50)
    d = crowd_features(arr, flow, ["stop_id", "line_id", "hour_of_day", "day_of_week", "weather_condition"],
                       ["o_orderkey"], "actual_arrival", "2000-01-01")
    return d.select("l_orderkey", "l_linenumber", r4("avg_passengers_waiting").alias("avg_passengers_waiting"),
                    "hour_of_day", "stop_type", "passengers_waiting", "split")


QUERIES = {
    "dim_join_roles": q_dim_join_roles,
    "baseline_join": q_baseline_join,
    "weather_hour_join": q_weather_hour_join,
    "calendar_unroll": q_calendar_unroll,
    "holiday_flag": q_holiday_flag,
    "calendar_features": q_calendar_features,
    "metrics_global": q_metrics_global,
    "metrics_by_k": q_metrics_by_k,
    "mape_nonzero": q_mape_nonzero,
    "chained_prediction": q_chained_prediction,
    "confidence_score": q_confidence_score,
    "gtfs_time_parse": q_gtfs_time_parse,
    "coord_repair": q_coord_repair,
    "props_json": q_props_json,
    "polyline_points": q_polyline_points,
    "centroid": q_centroid,
    "schedule_vs_model": q_schedule_vs_model,
    "od_pairs_legs": q_od_pairs_legs,
    "quality_report": q_quality_report,
    "quality_by_split": q_quality_by_split,
    "ids_and_clocks": q_ids_and_clocks,
    "tables_on_disk": q_tables_on_disk,
    "distinct_counts": q_distinct_counts,
    "delay_features": q_delay_features,
    "crowd_features": q_crowd_features,
}


# ---------------------------------------------------------------------------
# GTFS bundle derived from the TPC-H tables; C1 / C2 composites
# ---------------------------------------------------------------------------
def tpch_gtfs(spark: SparkSession, sf: str) -> dict:
    """All-string GTFS tables: nation -> calendar, orders -> trips (route = priority),
    lineitem -> stop_times (clock 20+line h, partkey%60 min, so some pass 24 h),
    supplier -> stops (some without latitude)."""
    cal = _calendar_from_nation(spark, sf).withColumn("service_id", F.col("service_id").cast("string"))
    trips = (_t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .select(F.col("o_orderkey").cast("string").alias("trip_id"),
                     F.col("c_nationkey").cast("string").alias("service_id"),
                     F.col("o_orderpriority").alias("route_id"),
                     F.when(F.col("o_orderstatus") != "P", F.lit("1")).alias("direction_id"),
                     F.lit(None).cast("string").alias("shape_id")))
    li = _t(spark, sf, "lineitem")
    hh = (F.col("l_linenumber") + 20).cast("string")
    mm = F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0")
    st = li.select(F.col("l_orderkey").cast("string").alias("trip_id"),
                   F.concat_ws(":", hh, mm, F.lit("00")).alias("arrival_time"),
                   F.concat_ws(":", hh, mm, F.lit("30")).alias("departure_time"),
                   F.col("l_suppkey").cast("string").alias("stop_id"),
                   F.col("l_linenumber").cast("string").alias("stop_sequence"))
    s = _t(spark, sf, "supplier")
    stops = s.select(F.col("s_suppkey").cast("string").alias("stop_id"), F.col("s_name").alias("stop_name"),
                     F.when(F.col("s_suppkey") % 23 != 0, F.lit(40) + F.col("s_acctbal") / 10000)
                     .cast("string").alias("stop_lat"),
                     (F.lit(-3) - F.col("s_nationkey") / 100.0).cast("string").alias("stop_lon"))
    # Half of the route types are road transit (9, 10), one comes padded.
    n = F.substring("route_id", 1, 1).cast("int")
    kind = F.when(n == 1, " 9 ").when(n == 3, "10").when(n == 5, "9").otherwise("2")
    routes = trips.select("route_id").distinct().select(
        "route_id", F.col("route_id").alias("route_short_name"), F.lit(None).cast("string").alias("route_long_name"),
        kind.alias("route_type"))
    return {"calendar": cal, "trips": trips, "stop_times": st, "stops": stops, "routes": routes}


def q_schedule_legs(spark: SparkSession, sf: str) -> DataFrame:
    """8 simulated days from the calendar's first start date -> scheduled legs."""
    from .schedule import unroll_gtfs_legs
    legs = unroll_gtfs_legs(tpch_gtfs(spark, sf))
    return legs.select("trip_date_id", "stop_id_origen", "stop_id_destino",
                       F.unix_micros(F.col("cikis_zaman").cast("timestamp")).alias("dep_us"),
                       F.unix_micros(F.col("varis_zaman").cast("timestamp")).alias("arr_us"),
                       "tiempo_viaje_base", "lat_o")


def q_schedule_leg_lags(spark: SparkSession, sf: str) -> DataFrame:
    """C1 + W2: scheduled legs with the speeds of the three previous legs of the simulated trip."""
    from .schedule import unroll_gtfs_legs
    legs = unroll_gtfs_legs(tpch_gtfs(spark, sf), n_lags=3)
    return legs.select("trip_date_id", "stop_id_origen", "stop_id_destino",
                       F.unix_micros(F.col("cikis_zaman").cast("timestamp")).alias("dep_us"),
                       *[F.round(f"vel_lag_{j}", 2).alias(f"vel_lag_{j}") for j in (1, 2, 3)])


def q_schedule_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Every scheduled stop visit replicated over 3 days as a ping."""
    from .schedule import expand_schedule
    return expand_schedule(tpch_gtfs(spark, sf), "2024-01-08", 3)


ROUTES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRESETS = ["Clear", "Rain", "Snow"]


def q_route_requests(spark: SparkSession, sf: str) -> DataFrame:
    """J13 + T13 + F6 + F10 + T10 + P19 + P20 + M9: every event asks for a trip between two stops of a
    route's first trip; only road routes have one; pairs of events are the known trips."""
    from .compare import compare_requests, trip_stop_list
    gtfs = tpch_gtfs(spark, sf)
    every = trip_stop_list(gtfs["trips"], gtfs["stop_times"], gtfs["stops"])
    on_trip = trip_stop_list(gtfs["trips"], gtfs["stop_times"], gtfs["stops"], gtfs["routes"])
    by_place = sequence.keep_first(every, ["route_id", "stop_sequence"], ["stop_id"], ["stop_name"])
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), (c % len(names) + 1).cast("int"))
    ev = stop_events(spark, sf)
    ask = ev.select(F.col("event_id").alias("request_id"), pick(ROUTES, F.col("user_id")).alias("route_id"),
                    (F.col("event_id") % 3 + 1).cast("int").alias("_o"), (F.col("event_id") % 7 + 1).cast("int").alias("_d"),
                    F.hour("ts").alias("hora_del_dia"), pick(PRESETS, F.col("event_id")).alias("weather"))
    for place, name in (("_o", "origin_name"), ("_d", "dest_name")):
        ask = ask.join(by_place.select("route_id", F.col("stop_sequence").alias(place), F.col("stop_name").alias(name)),
                       ["route_id", place], "left")
    pairs = _scored_pairs(spark, sf).select(
        F.concat_ws("-", "o_event_id", "d_event_id").alias("id"), F.col("k").alias("hops"), "tt", "dist_m")
    model = lambda d: d.withColumn("prediction", F.col("dist_m") / 6.0 + 20.0 * F.col("precipitation"))
    c = compare_requests(ask.drop("_o", "_d"), on_trip, pairs, model, enrich.weather_presets(spark))
    return c.select("request_id", "is_valid", "reject_reason", F.col("intermediate_stops").cast("long").alias("stops"),
                    r4("actual_s").alias("actual_s"), r4("velocity_m_s").alias("velocity_m_s"), r4("sched_s").alias("sched_s"),
                    r4("predicted_s").alias("predicted_s"), r4("improvement_pct").alias("improvement_pct"), "model_wins")


def q_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """5 % of the bounded O-D pairs of every horizon (hash-based, repeatable)."""
    p = EQ.bounded_pairs(stop_events(spark, sf))
    return splits.stratified_sample(p, "k", ["o_event_id", "d_event_id"], 0.05).select(
        "o_event_id", "d_event_id", F.col("k").cast("long").alias("k"))


def q_sample_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All events of 10 users chosen by a seeded hash (the limit is the feature)."""
    return splits.sample_entities(stop_events(spark, sf), ENTITY, 10).select("event_id", ENTITY)


def q_row_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly 3,000 of the events, those with the smallest hashes."""
    return splits.row_cap(stop_events(spark, sf), ["event_id"], 3000).select("event_id", ENTITY)


def q_holdout_flag(spark: SparkSession, sf: str) -> DataFrame:
    """The fifth of the users that is held out, on every event."""
    return stop_events(spark, sf).select("event_id", splits.holdout_flag([ENTITY], 20.0).alias("held_out"))


def q_row_index(spark: SparkSession, sf: str) -> DataFrame:
    """0-based position of every event within its user."""
    d = sequence.row_index(stop_events(spark, sf), ENTITY, ORDER, "row_in_entity")
    return d.select("event_id", F.col("row_in_entity").cast("long").alias("row_in_entity"))


def q_snap_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's position to the nearest stop within 400 m, the sentinel without one."""
    from ..operators.snap import snap_to_stops
    key = F.col("s_suppkey")
    stops = _t(spark, sf, "supplier").select(key.cast("string").alias("stop_id"),
                                             (F.lit(41) + (key * 7919 % 9973) / 99730.0).alias("stop_lat"),
                                             (F.lit(28.9) + (key * 104729 % 9967) / 99670.0).alias("stop_lon"))
    d = snap_to_stops(stop_events(spark, sf).select("event_id", "lat", "lon"), stops, 400.0)
    return d.select("event_id", F.coalesce("snapped_stop_id", F.lit(UNKNOWN_STOP)).alias("stop_id"),
                    F.floor(F.col("snap_m") * 100 + 0.5).cast("long").alias("snap_cm"))


def _horizon_parts(spark: SparkSession, sf: str) -> str:
    from ..sources.sinks import write_by_horizon
    path = scratch_path(spark, "horizons")
    write_by_horizon(_scored_pairs(spark, sf).select("o_event_id", "d_event_id", "tt", "k"), path)
    return path


def q_horizon_parts(spark: SparkSession, sf: str) -> DataFrame:
    """K1 + S7: the bounded pairs written as one part per horizon, read back and added up."""
    from ..sources.readers import read_features
    d = read_features(spark, _horizon_parts(spark, sf))
    return d.groupBy(F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), r4(F.sum("tt")).alias("tt"))


def q_tolerant_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Horizon parts among which are a text file, a file of a few bytes and a part named without a number:
    the rows of the good parts, and the skipped files with the reason."""
    from ..sources.readers import read_features_tolerant
    path = _horizon_parts(spark, sf)
    one = read_table(spark, sf, "region").limit(1)
    one.select(F.repeat(F.lit("not Parquet "), 9).alias("t")).coalesce(1).write.text(f"{path}/k=11")
    one.select(F.lit("cut").alias("t")).coalesce(1).write.text(f"{path}/k=12")
    one.select(F.lit(1).cast("long").alias("o_event_id")).coalesce(1).write.parquet(f"{path}/k=eleven")
    good, skipped = read_features_tolerant(spark, path)
    n = F.count(F.lit(1)).alias("n")
    return good.groupBy(F.col("k").cast("string").alias("part"), F.lit(None).cast("string").alias("reason")).agg(n).unionByName(
        skipped.groupBy("part", "reason").agg(n))


# Names with letters that the Turkish code pages have and Latin-1 lacks.
STOP_NAMES = ("Kızılay Şubesi ", "Çayırbaşı İğde ", "Ümraniye Göztepe ", "Şişli � Ğ ")


def q_stops_by_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Stops landed as CSV files in iso-8859-9, windows-1254 and utf-8 (one holds U+FFFD), read together."""
    from ..sources.readers import read_csv_fallback
    s = read_table(spark, sf, "supplier").select("s_suppkey")
    root = scratch_path(spark, "encoded-stops")
    turkish, latin = "ĞİŞğış", "ÐÝÞðýþ"                      # the same bytes in iso-8859-9 and windows-1254
    for i, name in enumerate(STOP_NAMES):
        key = F.col("s_suppkey").cast("string")
        line = F.concat(key, F.lit(',"'), F.lit(name), key, F.lit('"'))
        rows = s.where(F.col("s_suppkey") % 4 == i).select(line.alias("t"), F.lit(1).alias("at"))
        head = read_table(spark, sf, "region").limit(1).select(F.lit("stop_id,stop_name").alias("t"), F.lit(0).alias("at"))
        d = head.unionByName(rows).repartition(1).sortWithinPartitions("at").select("t")
        if i < 2:
            d = d.select(F.encode(F.translate("t", turkish, latin), "ISO-8859-1").cast("string").alias("t"))
        d.write.text(f"{root}/{i}")
    return read_csv_fallback(spark, [f"{root}/{i}" for i in range(len(STOP_NAMES))], ["stop_id", "stop_name"], with_encoding=True)


QUERIES.update({
    "horizon_parts": q_horizon_parts,
    "tolerant_parts": q_tolerant_parts,
    "stops_by_encoding": q_stops_by_encoding,
    "snap_stops": q_snap_stops,
    "schedule_legs": q_schedule_legs,
    "schedule_leg_lags": q_schedule_leg_lags,
    "schedule_expansion": q_schedule_expansion,
    "route_requests": q_route_requests,
    "stratified_sample": q_stratified_sample,
    "row_cap": q_row_cap,
    "holdout_flag": q_holdout_flag,
    "sample_entities": q_sample_entities,
    "row_index": q_row_index,
})


def q_leg_log_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Leg-log composite on the events: each event to the next event of the user is a leg;
    contiguous repeats collapse (W6/A3), legs under 30 s drop (F4), trips are rebuilt on
    route change, a stop-over over 15 min or a spatial break (W7)."""
    from .leg_logs import collapse_repeats, rebuild_trips
    ev = stop_events(spark, sf)
    legs = sequence.next_leg(ev, ENTITY, ORDER, ["stop_id", "ts"])
    legs = legs.select(F.col(ENTITY).alias("vehicle_id"), F.col("route_id").cast("string").alias("route_id"),
                       F.col("stop_id").alias("stop_id_origen"), F.col("next_stop_id").alias("stop_id_destino"),
                       F.col("ts").cast("timestamp").alias("cikis_zaman"),
                       F.col("next_ts").cast("timestamp").alias("varis_zaman"))
    t = rebuild_trips(collapse_repeats(legs))
    return t.select("vehicle_id", F.unix_micros("cikis_zaman").alias("dep_us"),
                    F.unix_micros("varis_zaman").alias("arr_us"), "stop_id_origen", "stop_id_destino",
                    F.col("trip_no").cast("long").alias("trip_no"))


QUERIES["leg_log_trips"] = q_leg_log_trips
