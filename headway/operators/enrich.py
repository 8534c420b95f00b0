"""Dimension joins and calendar / weather enrichment.

Broadcast policy: a side is broadcast only after its optimizer size estimate is checked
against ``MAX_BROADCAST_BYTES`` (``checked_broadcast``); otherwise the join is left to
Spark (sort-merge, or a runtime broadcast chosen by AQE from the real shuffle size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import hour_key, local_wall
from .sequence import _as_list, fill_forward_backward, keep_first

MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan (no job is run)."""
    try:
        v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(v if isinstance(v, int) else v.toString())
    except Exception:  # noqa: BLE001 - estimate unavailable (e.g. Connect)
        return None


def checked_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the estimated size is known and under ``max_bytes``."""
    n = estimated_bytes(df)
    return F.broadcast(df) if n is not None and n <= max_bytes else df


# ---------------------------------------------------------------------------
# Dimension joins
# ---------------------------------------------------------------------------
def attach_stops(df: DataFrame, stops: DataFrame, key: str = "stop_id", how: str = "left",
                 prefix: str = "") -> DataFrame:
    """Left join of stop coordinates (null when the stop is unknown)."""
    s = stops.select(F.col(key), *[F.col(c).alias(prefix + c) for c in stops.columns if c != key])
    return df.join(checked_broadcast(s), key, how)


def attach_trips(stop_times: DataFrame, trips: DataFrame, key: str = "trip_id",
                 cols=("route_id", "direction_id"), default_direction: str | None = "0") -> DataFrame:
    """stop_times left-join trips (route, direction); null direction -> '0'."""
    t = trips.select(key, *cols)
    out = stop_times.join(checked_broadcast(t), key, "left")
    if default_direction is not None and "direction_id" in cols:
        out = out.withColumn("direction_id", F.coalesce(F.col("direction_id"), F.lit(default_direction)))
    return out


def attach_od_stops(legs: DataFrame, stops: DataFrame, o_key: str, d_key: str, key: str = "stop_id",
                    cols=("stop_lat", "stop_lon")) -> DataFrame:
    """The stop dimension in two roles (origin, destination); inner joins, so legs
    with an unknown stop are dropped. Null keys never match (documented deviation N11)."""
    dim = checked_broadcast(stops.where(F.col(key).isNotNull()).select(key, *cols))
    o = dim.select(F.col(key).alias(o_key), *[F.col(c).alias(f"o_{c}") for c in cols])
    d = dim.select(F.col(key).alias(d_key), *[F.col(c).alias(f"d_{c}") for c in cols])
    return legs.join(o, o_key, "inner").join(d, d_key, "inner")


def attach_distance(arrivals: DataFrame, stops: DataFrame, key: str = "stop_id",
                    col: str = "distance_from_prev_km") -> DataFrame:
    """Left join without dedupe (duplicate stop rows multiply, as in the source),
    missing distance -> 0.0."""
    return (arrivals.join(checked_broadcast(stops.select(key, col)), key, "left")
            .withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(0.0))))


def keep_members(df: DataFrame, members: DataFrame, key) -> DataFrame:
    """Rows whose key is in the chosen set (left-semi)."""
    return df.join(members.select(*_as_list(key)), _as_list(key), "left_semi")


# ---------------------------------------------------------------------------
# Contextual baseline
# ---------------------------------------------------------------------------
def attach_baseline(df: DataFrame, baseline: DataFrame, keys, value: str, order=None,
                    default: float = 0.0) -> DataFrame:
    """Dedupe the baseline by ``keys`` (first by ``order`` wins, A8), left join on
    all keys, missing -> ``default``."""
    keys = _as_list(keys)
    b = keep_first(baseline, keys, order, [value]) if order else baseline.select(*keys, value)
    return (df.join(b, keys, "left")
            .withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(default))))


# ---------------------------------------------------------------------------
# weather
# ---------------------------------------------------------------------------
def attach_weather_hour(df: DataFrame, weather: DataFrame, ts, wall_tz: str | None = None,
                        naive_as_utc: bool = False, cols=("temperature_2m", "precipitation", "snowfall"),
                        fill: dict | None = None) -> DataFrame:
    """Left join on the UTC hour bucket of ``ts`` (P9; ``wall_tz`` only when ``ts``
    is local wall time). ``fill`` gives per-column defaults for hours without weather
    (``None`` keeps null)."""
    w = weather.select(F.col("hour_key"), *cols)
    out = df.withColumn("hour_key", hour_key(ts, wall_tz, naive_as_utc)).join(checked_broadcast(w), "hour_key", "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def attach_weather_profile(df: DataFrame, profile: DataFrame, hour_col: str = "hora_del_dia",
                           cols=("temperature_2m", "precipitation")) -> DataFrame:
    """Left join on hour of day to a one-day profile; missing -> 0."""
    p = profile.select(F.col(hour_col), *cols)
    out = df.join(checked_broadcast(p), hour_col, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return out


def every_hour(weather: DataFrame, facts: DataFrame, ts: str) -> DataFrame:
    """The weather with a row for each hour of its own range and that of ``facts.ts`` (values
    null in added hours); the hours come from one small aggregation, a row per hour."""
    hour = F.date_trunc("hour", F.col(ts).cast("timestamp"))
    spans = facts.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).unionByName(
        weather.agg(F.min("hour_key").alias("a"), F.max("hour_key").alias("b")))
    hours = spans.agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a IS NOT NULL").select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour_key"))
    return hours.join(weather, "hour_key", "left")


def needed_hours(weather: DataFrame, facts: DataFrame, ts: str) -> DataFrame:
    """The weather with a row for each hour in which ``facts.ts`` lies, too (values null in added hours).

    Fills look at the neighbouring rows that have a value, so hours that nobody looks up change nothing
    and are not made: a fact with a wrong year adds one hour, not (as ``every_hour``) all hours up to it.
    One partial aggregation, at most a row per hour of the facts."""
    hour = F.date_trunc("hour", F.col(ts).cast("timestamp"))
    hours = facts.select(hour.alias("hour_key")).distinct().unionByName(weather.select("hour_key"))
    return hours.where("hour_key IS NOT NULL").distinct().join(weather, "hour_key", "left")


def fill_weather(weather: DataFrame, cols=("temperature_2m",)) -> DataFrame:
    """W10 re-aimed: forward- then back-fill on the hourly weather dimension before the
    join (the source fills the joined fact frame, crossing vehicles; equal whenever the
    hour exists in the dimension)."""
    return fill_forward_backward(weather, ["hour_key"], list(cols))


# Weather presets of the comparison screen -> (temperature C, precipitation mm).
WEATHER_PRESETS = [("Clear", 25.0, 0.0), ("Rain", 14.0, 12.0), ("Snow", -2.0, 5.0)]


def weather_presets(spark) -> DataFrame:
    """P20: preset label -> (temperature_2m, precipitation) as a 3-row dimension."""
    return spark.createDataFrame(WEATHER_PRESETS, "preset string, temperature_2m double, precipitation double")


# ---------------------------------------------------------------------------
# calendar
# ---------------------------------------------------------------------------
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def active_service_days(calendar: DataFrame, start: str, days: int = 8) -> DataFrame:
    """(service_id, service_date) for every simulated day ``start .. start+days-1``
    on which the service is in range and runs on that weekday.

    The range test is done by exploding each service's own days (the calendar is a
    small dimension), not by a theta join against a date table."""
    from ..functions.timefmt import parse_yyyymmdd
    d0 = F.to_date(F.lit(start))
    cal = calendar.select(
        "service_id", parse_yyyymmdd("start_date").alias("_s"), parse_yyyymmdd("end_date").alias("_e"),
        F.array(*[F.col(w).try_cast("int") for w in WEEKDAYS]).alias("_flags"))
    ex = cal.select("service_id", "_s", "_e", "_flags",
                    F.explode(F.sequence(d0, F.date_add(d0, days - 1))).alias("service_date"))
    active = ex.where(F.col("service_date").between(F.col("_s"), F.col("_e"))
                      & (F.get(F.col("_flags"), F.weekday("service_date")) == 1))
    return active.select("service_id", "service_date")


def unroll_calendar(active: DataFrame, trips: DataFrame, stop_times: DataFrame | None = None,
                    trip_key: str = "trip_id") -> DataFrame:
    """J8 + P13: active days x trips (x stop_times) with ``trip_date_id`` =
    ``trip_id + '_' + yyyyMMdd``. The day table is broadcast after a size check."""
    t = trips.join(checked_broadcast(active), "service_id", "inner")
    t = t.withColumn("trip_date_id", F.concat_ws("_", F.col(trip_key).cast("string"),
                                                 F.date_format("service_date", "yyyyMMdd")))
    if stop_times is not None:
        t = stop_times.join(t, trip_key, "inner")
    return t


def holiday_flag(df: DataFrame, holidays: DataFrame, ts, tz: str | None = None, out: str = "is_holiday",
                 region: str | None = None) -> DataFrame:
    """1.0 when the local date of ``ts`` is a holiday, else 0.0."""
    h = holidays if region is None else holidays.where(F.col("region") == region)
    h = h.select(F.col("date").alias("_hd")).distinct().withColumn("_hit", F.lit(1.0))
    d = df.withColumn("_hd", F.to_date(local_wall(ts, tz)))
    return (d.join(checked_broadcast(h), "_hd", "left")
             .withColumn(out, F.coalesce(F.col("_hit"), F.lit(0.0))).drop("_hd", "_hit"))


def replicate_days(df: DataFrame, start: str, days: int, out: str = "service_date") -> DataFrame:
    """One copy of each row per simulated day (``explode(sequence)``, no cross join)."""
    d0 = F.to_date(F.lit(start))
    return df.withColumn(out, F.explode(F.sequence(d0, F.date_add(d0, days - 1))))
