"""Clock, date and calendar helpers as native Column expressions.

Covers X2-X5, X7, X8, X10, X16, P8-P10. Session time zone is assumed UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _clock_parts(s: Column):
    parts = F.split(F.trim(s.cast("string")), ":")
    return parts, [F.get(parts, i).try_cast("int") for i in range(3)]


def clock_to_seconds(s, on_error: str = "null") -> Column:
    """GTFS ``HH:MM:SS`` (hours may exceed 23) -> seconds after midnight.

    ``on_error='null'``: empty, wrong arity or non-integer parts give null.
    ``on_error='raise'``: the same inputs fail the job with a clear message.
    """
    col = _c(s)
    parts, (h, m, sec) = _clock_parts(col)
    ok = (F.size(parts) == 3) & h.isNotNull() & m.isNotNull() & sec.isNotNull()
    secs = h.cast("long") * 3600 + m.cast("long") * 60 + sec.cast("long")
    if on_error == "raise":
        return F.when(col.isNull(), F.lit(None).cast("long")).when(ok, secs).otherwise(
            F.raise_error(F.concat(F.lit("bad clock value: "), col.cast("string"))).cast("long"))
    return F.when(ok, secs)


def date_plus_clock(date_col, seconds_col) -> Column:
    """Service date + clock seconds -> naive timestamp (local wall time, >24 h rolls over)."""
    d = _c(date_col).cast("date").cast("timestamp_ntz")
    return d + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(seconds_col).cast("decimal(18,6)"))


def epoch1900_clock_to_instant(service_date, clock_ts, tz: str) -> Column:
    """Boston style: a clock stored on 1900-01-01 (or -02 for >24 h) is added as an
    absolute duration to local midnight of the service date (so on DST days the wall
    time shifts by an hour, as the source feed does)."""
    midnight_utc = F.to_utc_timestamp(_c(service_date).cast("date").cast("timestamp"), tz)
    dur = F.unix_micros(_c(clock_ts).cast("timestamp")) - F.unix_micros(F.lit("1900-01-01 00:00:00").cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(midnight_utc) + dur)


def epoch_seconds_to_local(sec, tz: str) -> Column:
    """Epoch seconds -> local wall-clock timestamp in ``tz``."""
    return F.from_utc_timestamp(F.timestamp_seconds(_c(sec)), tz)


def parse_yyyymmdd(s) -> Column:
    """``yyyyMMdd`` string -> date, null when unparsable."""
    return F.try_to_timestamp(_c(s).cast("string"), F.lit("yyyyMMdd")).cast("date")


def weekday_name(d) -> Column:
    """Lower-case English weekday name of a date."""
    return F.lower(F.date_format(_c(d), "EEEE"))


def local_wall(ts, tz: str | None) -> Column:
    """Local wall time of an instant (``tz=None`` keeps the value as is)."""
    c = _c(ts)
    return c if tz is None else F.from_utc_timestamp(c.cast("timestamp"), tz)


def calendar_features(ts, tz: str | None = None, prefix: str = "") -> list[Column]:
    """Hour of day, Monday-0 weekday and month of the local wall time."""
    w = local_wall(ts, tz)
    return [F.hour(w).cast("int").alias(f"{prefix}hora_del_dia"),
            F.weekday(w).cast("int").alias(f"{prefix}dia_semana"),
            F.month(w).cast("int").alias(f"{prefix}mes")]


def hour_key(ts, wall_tz: str | None = None, naive_as_utc: bool = False) -> Column:
    """UTC hour bucket used to join hourly weather.

    ``ts`` is an instant (floored in UTC) unless ``wall_tz`` says it is local wall time
    of that zone, which is converted to UTC first. ``naive_as_utc=True`` reproduces the
    feeds that relabel local wall time as UTC (the wall value is floored unchanged).
    """
    c = _c(ts)
    if naive_as_utc or wall_tz is None:
        return F.date_trunc("hour", c.cast("timestamp"))
    return F.date_trunc("hour", F.to_utc_timestamp(c.cast("timestamp"), wall_tz))


def hour_of_day_from_seconds(s) -> Column:
    """P10: ``(s // 3600) % 24`` for clocks past midnight."""
    return F.pmod(F.floor(_c(s) / 3600), F.lit(24)).cast("int")


def seconds_of_day(ts) -> Column:
    """Time of day in seconds."""
    c = _c(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


_OFFSET_RE = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_event_time(s, default_tz: str = "America/New_York") -> list[Column]:
    """ISO event time -> (hora, dia_semana, mes, event_ts UTC instant).

    An explicit offset keeps the wall clock of that offset for the calendar fields;
    a naive value is read as wall time in ``default_tz``; empty or bad -> now (UTC).
    """
    raw = F.trim(_c(s).cast("string"))
    has_off = raw.rlike(_OFFSET_RE)
    wall_txt = F.regexp_replace(raw, _OFFSET_RE, "")
    wall = F.try_to_timestamp(F.regexp_replace(wall_txt, "T", " "))
    inst_off = F.try_to_timestamp(raw)  # parses the offset into a UTC instant
    inst_naive = F.to_utc_timestamp(wall, default_tz)
    good = F.when(has_off, inst_off.isNotNull() & wall.isNotNull()).otherwise(wall.isNotNull())
    now = F.current_timestamp()
    wall_used = F.when(good, wall).otherwise(now)
    inst = F.when(good, F.when(has_off, inst_off).otherwise(inst_naive)).otherwise(now)
    return [F.hour(wall_used).alias("hora_del_dia"), F.weekday(wall_used).alias("dia_semana"),
            F.month(wall_used).alias("mes"), inst.alias("event_ts")]
