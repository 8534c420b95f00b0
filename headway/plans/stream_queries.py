"""Driver queries that run the streaming jobs to completion (``availableNow``).

The events table is landed as feed / stop-event JSON files in the shared checkpoint
folder, the streaming job processes them in several micro-batches, and the query
returns the resulting table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import feed, live_eta, lookup
from .context_queries import _hourly_weather
from .events_model import stop_events

LOG_CAP = 2000
RETAINED_S = 12 * 3600
STATUS_CYCLE = ["0", "1", "2", "STOPPED_AT", "bogus"]


def land_positions(spark: SparkSession, sf: str, files: int | None = None, repeated: bool = False) -> str:
    """Events as GTFS-rt-like JSON entities; some lack a vehicle, some have an empty
    vehicle id, the status comes as a code, a name or garbage. ``repeated`` delivers every third one twice."""
    ev = stop_events(spark, sf)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_CYCLE]), (F.col("event_id") % 5 + 1).cast("int"))
    veh = F.struct(
        F.struct(F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
                 .alias("id")).alias("vehicle"),
        F.struct((F.col("user_id") % 7).cast("string").alias("route_id")).alias("trip"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position"),
        F.floor(F.col("t_us") / 1e6).cast("long").alias("timestamp"),
        status.alias("current_status"))
    ent = ev.select(F.col("event_id").cast("string").alias("id"),
                    F.when(F.col("event_id") % 19 != 0, veh).alias("vehicle"))
    if repeated:
        ent = ent.unionByName(ent.where(F.col("id").cast("long") % 3 == 0))
    if files:
        ent = ent.repartition(files, F.xxhash64("id"))
    path = scratch_path(spark, "feed-landing")
    ent.write.json(path)
    return path


def q_ingest_positions(spark: SparkSession, sf: str) -> DataFrame:
    """S11 + P1 + R1/R2 + K4: stream the landed feed into the position log."""
    landing = land_positions(spark, sf)
    log, ck = scratch_path(spark, "position-log"), scratch_path(spark, "position-log-ck")
    q = feed.start_ingest(spark, landing, log, ck, available_now=True)
    q.awaitTermination()
    return _position_rows(spark.read.parquet(log))


def _position_rows(log: DataFrame) -> DataFrame:
    return log.select("vehicle_id", "route_id", F.col("latitude").cast("double").alias("latitude"),
                      F.col("longitude").cast("double").alias("longitude"),
                      F.col("timestamp").cast("long").alias("timestamp"), "current_status")


def q_position_log_capped(spark: SparkSession, sf: str) -> DataFrame:
    """R7 + K4: all events streamed in six batches into a log capped at its newest 2,000 records."""
    landing = land_positions(spark, sf, files=6)
    log, ck = scratch_path(spark, "capped-log"), scratch_path(spark, "capped-log-ck")
    feed.start_ingest(spark, landing, log, ck, available_now=True, max_files_per_trigger=1,
                      keep=LOG_CAP).awaitTermination()
    return _position_rows(feed.CappedLog(spark, log, LOG_CAP).read())


def q_positions_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Re-polled positions: every third event comes twice, in any order and batch; one of each stays."""
    landing = land_positions(spark, sf, files=4, repeated=True)
    log, ck = scratch_path(spark, "dedup-log"), scratch_path(spark, "dedup-log-ck")
    feed.start_ingest(spark, landing, log, ck, available_now=True, max_files_per_trigger=2,
                      repeats_within="60 days").awaitTermination()
    return _position_rows(spark.read.parquet(log))


def land_stop_events(spark: SparkSession, sf: str) -> str:
    """Events as stop-event messages: padded route ids, a missing stop id (rejected),
    naive times (New York wall clock) and times with a +03:00 offset."""
    ev = stop_events(spark, sf)
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    route = (F.col("user_id") % 7).cast("string")
    k = F.get_json_object("props", "$.k").try_cast("long")
    msg = ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 9 == 0, F.concat(F.lit(" "), route, F.lit(" "))).otherwise(route).alias("route_id"),
        F.lit("0").alias("direction_id"),
        F.when(F.col("event_id") % 23 == 0, F.lit("")).otherwise(F.col("event_type")).alias("stop_id"),
        F.concat(F.lit("stop_"), (k % 5).cast("string")).alias("next_stop_id"),
        F.col("user_id").cast("string").alias("half_trip_id"),
        F.when(F.col("event_id") % 4 == 0, F.concat(wall, F.lit("+03:00"))).otherwise(wall).alias("actual_ts"))
    path = scratch_path(spark, "stop-events")
    msg.write.json(path)
    return path


def live_table(spark: SparkSession, sf: str, totals: str | None = None, retain_s: int | None = None) -> DataFrame:
    landing = land_stop_events(spark, sf)
    wpath = scratch_path(spark, "weather")
    _hourly_weather(stop_events(spark, sf)).withColumn("snowfall", F.lit(0.0)).write.parquet(wpath)
    root, ck, dl = (scratch_path(spark, n) for n in ("eta-live", "eta-live-ck", "eta-dead-letter"))
    src = live_eta.read_stop_events(spark, landing, max_files_per_trigger=1)
    q = live_eta.start_scorer(spark, src, root, ck, weather_path=wpath, dead_letter=dl, available_now=True,
                              totals=totals, retain_s=retain_s)
    q.awaitTermination()
    return live_eta.LiveTable(spark, root, retain_s).read()


def q_eta_latest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """R3-R6 + K5: newest scored ETA per (route, stop, next stop)."""
    t = live_table(spark, sf)
    return t.select(*live_eta.KEY, "direction_id", "eta_segundos", "nivel_confianza",
                    F.col("hora_del_dia").cast("long").alias("hora_del_dia"),
                    F.col("dia_semana").cast("long").alias("dia_semana"), F.col("mes").cast("long").alias("mes"),
                    F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ultima_actualizacion").alias("updated_us"))


def q_eta_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks for one key; found / expired (older than 300 s before the
    newest update) / not found."""
    t = live_table(spark, sf)
    now = t.agg(F.max("ultima_actualizacion")).scalar()
    ev = stop_events(spark, sf)
    k = F.get_json_object("props", "$.k").try_cast("long")
    req = ev.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 7).cast("string").alias("route_id"),
                    F.col("event_type").alias("stop_id"),
                    F.concat(F.lit("stop_"), ((k + F.col("event_id")) % 5).cast("string")).alias("next_stop_id"))
    r = lookup.lookup_eta(req, t, now)
    return r.select("request_id", "status", "eta_segundos")


def q_eta_live_keys(spark: SparkSession, sf: str) -> DataFrame:
    """K5: the keys updated within twelve hours before the newest update; the others have expired."""
    t = live_table(spark, sf, retain_s=RETAINED_S)
    return t.select(*live_eta.KEY, "eta_segundos", F.unix_micros("ultima_actualizacion").alias("updated_us"))


def q_scorer_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How many stop events the scorer received, accepted and rejected."""
    totals = scratch_path(spark, "eta-totals")
    live_table(spark, sf, totals)
    return live_eta.scorer_totals(spark, totals)


QUERIES = {
    "scorer_totals": q_scorer_totals,
    "position_log_capped": q_position_log_capped,
    "positions_deduplicated": q_positions_deduplicated,
    "eta_live_keys": q_eta_live_keys,
    "ingest_positions": q_ingest_positions,
    "eta_latest_stream": q_eta_latest_stream,
    "eta_lookup": q_eta_lookup,
}
