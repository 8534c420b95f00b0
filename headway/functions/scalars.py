"""Scoring and arithmetic helpers (X9, X11-X15, X17, P12, P16-P20) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Fixed values of the confidence heuristic (P16): base, clamp and step sizes.
CONF_BASE = 0.75
CONF_MIN, CONF_MAX = 0.10, 0.99
RUSH_HOURS = ((7, 9), (17, 19))          # inclusive ranges
RUSH_PENALTY = 0.12
SHORT_ETA_S, SHORT_BONUS = 60.0, 0.10
LONG_ETA_S, LONG_PENALTY = 900.0, 0.10
WEEKEND_FROM, WEEKEND_PENALTY = 5, 0.05
RAIN_HEAVY_MM, RAIN_HEAVY_PENALTY = 5.0, 0.10
RAIN_LIGHT_MM, RAIN_LIGHT_PENALTY = 1.0, 0.05
SNOW_HEAVY_CM, SNOW_HEAVY_PENALTY = 2.0, 0.15
SNOW_LIGHT_CM, SNOW_LIGHT_PENALTY = 0.5, 0.08


def confidence(hour, weekday, eta_s, precipitation, snowfall) -> Column:
    """Heuristic confidence in [0.10, 0.99], rounded to two decimals."""
    h, d, e, p, s = map(_c, (hour, weekday, eta_s, precipitation, snowfall))
    rush = (h.between(*RUSH_HOURS[0]) | h.between(*RUSH_HOURS[1]))
    terms = (F.lit(CONF_BASE)
             - F.when(rush, RUSH_PENALTY).otherwise(0.0)
             + F.when(e < SHORT_ETA_S, SHORT_BONUS).when(e > LONG_ETA_S, -LONG_PENALTY).otherwise(0.0)
             - F.when(d >= WEEKEND_FROM, WEEKEND_PENALTY).otherwise(0.0)
             - F.when(p > RAIN_HEAVY_MM, RAIN_HEAVY_PENALTY).when(p > RAIN_LIGHT_MM, RAIN_LIGHT_PENALTY).otherwise(0.0)
             - F.when(s > SNOW_HEAVY_CM, SNOW_HEAVY_PENALTY).when(s > SNOW_LIGHT_CM, SNOW_LIGHT_PENALTY).otherwise(0.0))
    return F.round(F.greatest(F.lit(CONF_MIN), F.least(F.lit(CONF_MAX), terms)), 2)


def eta_postprocess(pred) -> Column:
    """Floor the prediction at 1 s and round half-even to one decimal."""
    return F.bround(F.greatest(F.lit(1.0), _c(pred).cast("double")), 1)


def safe_float(c, default: float = 0.0) -> Column:
    """Non-numeric or missing -> default."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(default))


def safe_ratio(num, den, fill: float | None = 0.0) -> Column:
    """Division where /0 (and null) gives ``fill`` instead of an error or inf."""
    q = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    q = F.when(F.isnan(q), None).otherwise(q)
    return q if fill is None else F.coalesce(q, F.lit(fill))


# Fixed value: scheduled fallback speed 15 km/h in m/s.
SCHEDULE_FALLBACK_MS = 15000.0 / 3600.0


def scheduled_eta(sched_diff_s, distance_m) -> Column:
    """Schedule difference when positive, else distance at 15 km/h."""
    d = _c(sched_diff_s)
    return F.when(d > 0, d.cast("double")).otherwise(_c(distance_m) / F.lit(SCHEDULE_FALLBACK_MS))


def improvement_pct(err_sched, err_model) -> Column:
    """(e_sched - e_model) / max(e_sched, 0.01) * 100, errors in seconds."""
    es, em = _c(err_sched), _c(err_model)
    return (es - em) / F.greatest(es, F.lit(0.01)) * 100.0


def segment_sizes(k, k_max: int) -> Column:
    """Balanced split of horizon ``k`` into ceil(k/k_max) segments.

    The first ``k mod m`` segments get one hop more: 25 with 15 -> [13, 12].
    """
    kc = _c(k).cast("int")
    m = F.floor((kc + (k_max - 1)) / k_max).cast("int")
    base = F.floor(kc / m).cast("int")
    rem = F.pmod(kc, m)
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: base + F.when(i < rem, 1).otherwise(0))


def clamp(c, lo, hi) -> Column:
    """Keep a value inside [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(c)))


def clean_id(c) -> Column:
    """Trim an id; empty becomes null."""
    t = F.trim(_c(c).cast("string"))
    return F.when(t != "", t)


def route_label(short, long) -> Column:
    """``short | long`` display label."""
    return F.concat_ws(" | ", _c(short), _c(long))


def any_null(cols) -> Column:
    """True when any of the columns is null."""
    out = F.lit(False)
    for c in cols:
        out = out | _c(c).isNull()
    return out
