"""Schedule-versus-model comparison (M9) as a batch job over O-D requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.scalars import clamp, improvement_pct, scheduled_eta
from ..functions.timefmt import clock_to_seconds
from ..operators import enrich, sequence, splits

# Fixed values of the comparison screen: hop clamp and minimum model time.
HOPS_MIN, HOPS_MAX = 1, 10
# Route types of road transit (F6), and the hop count that stands in for one without history.
ROAD_ROUTE_TYPES = ("9", "10")
HOPS_FALLBACK = 5


def compare_schedule_model(df: DataFrame, sched_diff_s: str, distance_m: str, actual_s: str,
                           predicted_s: str, hops: str, min_pred_s: float = 30.0) -> DataFrame:
    """Adds hops (clamped to [1, 10], P19), sched_s (X13), predicted_s (floored at
    ``min_pred_s``), absolute errors in minutes, improvement % (X14, its floor of 0.01 is in
    seconds) and model_wins (a tie goes to the model)."""
    out = (df.withColumn("hops", clamp(hops, HOPS_MIN, HOPS_MAX))
             .withColumn("sched_s", scheduled_eta(sched_diff_s, distance_m))
             .withColumn("predicted_s", F.greatest(F.lit(float(min_pred_s)), F.col(predicted_s)))
             .withColumn("_es", F.abs(F.col("sched_s") - F.col(actual_s)))
             .withColumn("_em", F.abs(F.col("predicted_s") - F.col(actual_s))))
    return (out.withColumn("error_sched_min", F.col("_es") / 60.0)
               .withColumn("error_model_min", F.col("_em") / 60.0)
               .withColumn("improvement_pct", improvement_pct("_es", "_em"))
               .withColumn("model_wins", F.col("_em") <= F.col("_es")).drop("_es", "_em"))


def validate_requests(requests: DataFrame, seq_o: str, seq_d: str) -> DataFrame:
    """a request is valid when the destination comes strictly after the origin in
    the trip; invalid ones are kept with a reason. ``intermediate_stops`` is the gap."""
    o, d = F.col(seq_o), F.col(seq_d)
    reason = (F.when(o.isNull() | d.isNull(), "unknown_stop")
               .when(d <= o, "destination_not_after_origin"))
    return (requests.withColumn("reject_reason", reason)
                    .withColumn("is_valid", F.col("reject_reason").isNull())
                    .withColumn("intermediate_stops", F.when(F.col("is_valid"), d - o)))


def trip_stop_list(trips: DataFrame, stop_times: DataFrame, stops: DataFrame,
                   routes: DataFrame | None = None) -> DataFrame:
    """J13 + T13: the stops of each route's first trip (smallest trip id) with name, place in the
    trip, scheduled second and coordinates. ``routes`` limits it to road routes (F6)."""
    if routes is not None:
        road = routes.where(F.trim(F.col("route_type").cast("string")).isin(*ROAD_ROUTE_TYPES))
        trips = enrich.keep_members(trips, road, "route_id")
    first = splits.first_by(trips, ["route_id"], ["trip_id"], ["trip_id"])
    st = stop_times.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("stop_sequence"),
                           clock_to_seconds("arrival_time").alias("sched_s"))
    s = stops.select("stop_id", "stop_name", F.col("stop_lat").try_cast("double").alias("lat"),
                     F.col("stop_lon").try_cast("double").alias("lon"))
    return st.join(first, "trip_id").join(s, "stop_id")


def _draw(text: Column) -> Column:
    """A number from the first 32 bits of the text's MD5, the same on every run."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def known_trips(history: DataFrame, hops: str, seconds: str, distance_m: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """Every trip of the history, numbered so that a hop count's trips follow each other.

    Returns (trips: place, tt, dist; counts: hops, first, n). Trips of a hop count come in
    the order of the hash of ``key``: one range shuffle, so a frequent hop count is spread
    over tasks. ``counts`` has a row for each hop count from ``HOPS_MIN`` to ``HOPS_MAX`` at most."""
    h = history.select(F.col(hops).cast("int").alias("hops"), F.md5(key.cast("binary")).alias("m"), key.alias("id"),
                       F.col(seconds).alias("tt"), F.col(distance_m).alias("dist"))
    h, _ = splits.global_row_numbers(h.where(F.col("hops").between(HOPS_MIN, HOPS_MAX)), ["hops", "m", "id", "tt", "dist"],
                                     "place")
    counts = h.groupBy("hops").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    return h.select("place", "tt", "dist"), counts


def compare_requests(requests: DataFrame, trip_stops: DataFrame, history: DataFrame,
                     predict: Callable[[DataFrame], DataFrame], presets: DataFrame) -> DataFrame:
    """M9 for a table of requests (request_id, route_id, origin_name, dest_name, hora_del_dia, weather).

    Both stops are looked up on the route's trip (its first stop of that name); F10 rejects
    requests whose destination does not follow, and they stay with the reason. A valid one
    draws one of all known trips of its hop count (``known_trips``; T10: the draw depends on the
    request alone; hop count 5 where there is none) by an equi-join on the trip's place, scales its
    time to the real distance (P19), takes the preset weather (P20), and compares timetable and
    ``predict`` (adds ``prediction``)."""
    at = sequence.keep_first(trip_stops, ["route_id", "stop_name"], ["stop_sequence", "sched_s", "stop_id"],
                             ["stop_id", "stop_sequence", "sched_s", "lat", "lon"])
    ends = {side: at.select("route_id", F.col("stop_name").alias(name), *[
        F.col(c).alias(f"{side}_{c}") for c in ("stop_id", "stop_sequence", "sched_s", "lat", "lon")])
        for side, name in (("o", "origin_name"), ("d", "dest_name"))}
    r = requests.join(ends["o"], ["route_id", "origin_name"], "left").join(ends["d"], ["route_id", "dest_name"], "left")
    r = validate_requests(r, "o_stop_sequence", "d_stop_sequence")
    ok = r.where("is_valid").withColumn("dist_m", haversine_m("o_lat", "o_lon", "d_lat", "d_lon")).withColumn(
        "model_hops", clamp(F.col("intermediate_stops"), HOPS_MIN, HOPS_MAX))
    ok = ok.join(presets.withColumnRenamed("preset", "weather"), "weather", "left")
    trips, counts = known_trips(history, "hops", "tt", "dist_m", F.col("id"))
    spare = counts.where(F.col("hops") == HOPS_FALLBACK).select(F.struct("first", "n")).scalar()
    ok = ok.join(F.broadcast(counts.select(F.col("hops").alias("model_hops"), F.struct("first", "n").alias("_of"))),
                 "model_hops", "left").withColumn("_of", F.coalesce("_of", spare))
    asked = F.concat_ws("|", "route_id", "origin_name", "dest_name", F.col("hora_del_dia").cast("string"), "weather")
    ok = ok.withColumn("place", F.col("_of.first") + F.pmod(_draw(asked), F.col("_of.n"))).join(trips, "place", "left")
    ok = ok.withColumn("actual_s", F.col("tt") * (F.col("dist_m") / F.greatest(F.col("dist"), F.lit(1.0))))
    ok = ok.withColumn("velocity_m_s", F.col("dist_m") / F.greatest("actual_s", F.lit(1.0))).withColumn(
        "sched_diff_s", F.col("d_sched_s") - F.col("o_sched_s"))
    done = compare_schedule_model(predict(ok), "sched_diff_s", "dist_m", "actual_s", "prediction", "intermediate_stops")
    return done.drop("place", "tt", "dist", "_of").unionByName(r.where(~F.col("is_valid")), allowMissingColumns=True)
