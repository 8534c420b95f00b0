"""Origin-destination feature ETL, one generic plan driven by ``CityConfig``.

Input is a *visits* frame (one row per vehicle at a stop) with standard columns:
``route_id, direction_id, stop_id, seq`` (order value inside the entity), ``t_us``
(event instant, epoch micros), ``lat, lon`` and the entity / order columns of the
config. The plan is lazy end to end:

    speed lags (W2) -> pairs (W4 bounded on train, band join on test) -> F1/F2
    -> leak-free historical mean with carried state (W5, J11) -> calendar (P8, J9)
    -> hourly weather (J5) -> D1 projection (P5) ; new state = merge (A5)

Shuffles (no hot entity): train = one by entity (lags and lookahead share the frame);
test = one by entity (lags) + one by (entity, time bucket) for the band pairs; then one by
O-D key ((O-D key, k, hour) for hot keys) for the historical mean over the materialised pairs. Dimensions
(weather hours, holidays) are broadcast only after a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collections.abc import Callable

from ..config import CLOCK_FEATURE_COLUMNS, OD_FEATURE_COLUMNS, CityConfig
from ..functions.geo import haversine_m
from ..functions.scalars import safe_ratio
from ..functions.timefmt import calendar_features, hour_of_day_from_seconds
from ..operators import enrich, history, sequence
from ..session import materialize

VISIT_COLS = ["route_id", "direction_id", "stop_id", "seq", "t_us", "lat", "lon"]


def od_pairs(visits: DataFrame, cfg: CityConfig, is_test: bool) -> DataFrame:
    """W2 + W4 + F1 + F2 + P11 on a visits frame; returns one row per O-D pair."""
    ent, order = list(cfg.entity), list(cfg.order)
    v = visits.withColumn("_t", F.col("t_us") / 1e6)
    lags = sequence.speed_lag_step("lat", "lon", "_t", n=3)
    o_cols = [*ent, "route_id", "direction_id", "stop_id", "seq", "t_us", "lat", "lon",
              "vel_lag_1", "vel_lag_2", "vel_lag_3"]
    d_cols = ["stop_id", "seq", "t_us", "lat", "lon"]
    order_col, back = "seq", 4
    if cfg.leg_input:
        # rows are legs (see legs_to_visits): pair k takes the destination of leg i+k, the
        # leg-speed lags come with the rows, and only the entity is required to match
        d_cols = ["dest_stop_id", "seq", "dest_t_us", "dest_lat", "dest_lon"]
        lags, order_col, back = None, None, 0
    if is_test:
        # lags, then all pairs within max_tt, from one frame: the positions of the lags are the pairs' too
        rn = None
        if lags is not None:
            v, rn = sequence.Seq(v, ent, order).run(lags, back=back, keep_rn=True), "_rn"
        p = sequence.band_pairs(v, ent, order, "_t", cfg.max_tt_s, o_cols, d_cols, order_col=order_col,
                                same_time=cfg.leg_input, rn_col=rn)
        p = p.drop(*ent)
    else:
        # lags (look-back 4) and lookahead (K) share one frame: one shuffle for both
        gap = ("seq", cfg.k_train) if cfg.order_gap_cap else None
        p = sequence.lookahead_pairs(v, ent, order, o_cols, d_cols, cfg.k_train, max_order_gap=gap,
                                     order_col=order_col, leg_input=cfg.leg_input, prepare=lags,
                                     prepare_back=back)
    if cfg.leg_input:
        p = (p.withColumnRenamed("d_dest_stop_id", "d_stop_id").withColumnRenamed("d_dest_t_us", "d_t_us")
              .withColumnRenamed("d_dest_lat", "d_lat").withColumnRenamed("d_dest_lon", "d_lon"))
    tt_us = F.col("d_t_us") - F.col("o_t_us")
    p = (p.withColumn("tt_us", tt_us).withColumn("tiempo_viaje_segundos", tt_us / 1e6)
          .where((F.col("tiempo_viaje_segundos") > 0) & (F.col("tiempo_viaje_segundos") <= cfg.max_tt_s))
          .withColumn("distancia_proyectada", haversine_m("o_lat", "o_lon", "d_lat", "d_lon"))
          .where(F.col("distancia_proyectada").isNotNull()))
    hops = (F.col("d_seq") - F.col("o_seq")) if cfg.order_gap_cap else F.col("k")
    places = ["o_lat", "o_lon", "d_lat", "d_lon"] if cfg.row == "clock" else []
    return p.select(
        F.col("o_route_id").alias("route_id"), F.col("o_direction_id").alias("direction_id"),
        F.col("o_stop_id").alias("stop_id_origen"), F.col("d_stop_id").alias("stop_id_destino"),
        "k", hops.cast("double").alias("num_paradas_salto"), "tt_us", "tiempo_viaje_segundos",
        "distancia_proyectada", F.col("o_t_us").alias("t_o_us"), (F.col("o_t_us") / 1e6).alias("t_o"),
        F.col("o_seq").alias("seq_o"), F.col("o_vel_lag_1").alias("vel_lag_1"),
        F.col("o_vel_lag_2").alias("vel_lag_2"), F.col("o_vel_lag_3").alias("vel_lag_3"), *places,
        *[F.col(f"o_{c}") for c in ent])


def run_split(visits: DataFrame, cfg: CityConfig, is_test: bool, state: DataFrame | None = None,
              weather: DataFrame | None = None, holidays: DataFrame | None = None,
              extra_cols=()) -> tuple[DataFrame, DataFrame]:
    """C3 for one split. Returns (D1 features with ``k`` [+ ``extra_cols`` such as the
    origin instant ``t_o_us``], new carried state)."""
    keys = list(cfg.state_keys)
    # the pair table feeds the historical mean (twice) and the new state: build it once
    pairs = materialize(od_pairs(visits, cfg, is_test))
    p = history.expanding_mean(pairs, keys, "tt_us", history.fallback_time("distancia_proyectada"),
                               "tiempo_promedio_historico", k_col="k", t_col="t_o",
                               tiebreak=["t_o_us", "seq_o", "stop_id_destino", *(f"o_{c}" for c in cfg.entity), "tt_us"],
                               state=state, divide_by=1e6)
    new_state = history.build_state(pairs, keys, "tt_us")
    if state is not None:
        new_state = history.merge_state(state, new_state, keys)
    if cfg.row == "clock":
        return project_clock(p, weather, extra_cols), new_state
    p = p.withColumn("_ts", F.timestamp_micros("t_o_us"))
    p = p.select("*", *calendar_features("_ts", cfg.tz))
    if holidays is not None:
        p = enrich.holiday_flag(p, holidays, "_ts", cfg.tz)
    else:
        p = p.withColumn("is_holiday", F.lit(0.0))
    if weather is not None:
        fill = {"precipitation": 0.0, "snowfall": 0.0}
        if cfg.temperature_fill == "zero":
            fill["temperature_2m"] = 0.0
        elif cfg.temperature_fill == "ffill":
            weather = enrich.fill_weather(enrich.needed_hours(weather, pairs.select(F.timestamp_micros("t_o_us").alias("_ts")), "_ts"), ["temperature_2m"])
        # _ts is the origin instant: its UTC hour is the key (naive feeds were already
        # read as UTC wall time, which is the relabelling of P9)
        p = enrich.attach_weather_hour(p, weather, "_ts", None, cfg.naive_as_utc, fill=fill)
    else:
        p = (p.withColumn("temperature_2m", F.lit(None).cast("double"))
              .withColumn("precipitation", F.lit(0.0)).withColumn("snowfall", F.lit(0.0)))
    return project_d1(p, extra_cols), new_state


def project_d1(p: DataFrame, extra_cols=()) -> DataFrame:
    """The canonical ordered feature row (float32 features, int8 calendar) + k."""
    f32 = ["tiempo_viaje_segundos", "temperature_2m", "precipitation", "snowfall", "is_holiday",
           "distancia_proyectada", "vel_lag_1", "vel_lag_2", "vel_lag_3", "num_paradas_salto",
           "tiempo_promedio_historico"]
    i8 = ["hora_del_dia", "dia_semana", "mes"]
    cols = []
    for c in OD_FEATURE_COLUMNS:
        col = F.col(c)
        cols.append((col.cast("float") if c in f32 else col.cast("byte") if c in i8 else col.cast("string")).alias(c))
    return p.select(*cols, F.col("k").cast("int").alias("k"), *extra_cols)


def project_clock(p: DataFrame, profile: DataFrame | None, extra_cols=()) -> DataFrame:
    """P5/P6 for the city without dates: hour from the clock (P10), the weather of one day by
    hour of day (J6; 0.0 where missing), leg speed (P12), coordinates of both stops, + k."""
    p = p.withColumn("hora_del_dia", hour_of_day_from_seconds("t_o"))
    if profile is None:
        p = p.withColumns({"temperature_2m": F.lit(0.0), "precipitation": F.lit(0.0)})
    else:
        p = enrich.attach_weather_profile(p, profile)
    p = p.withColumns({"velocidad_tramo_m_s": safe_ratio(F.col("distancia_proyectada"), F.col("tiempo_viaje_segundos")),
                       "num_paradas_salto": F.col("k")})
    p = p.withColumnsRenamed({"tiempo_viaje_segundos": "travel_time_seconds", "stop_id_origen": "stop_id",
                              "stop_id_destino": "dest_stop_id", "o_lat": "stop_lat", "o_lon": "stop_lon",
                              "d_lat": "dest_lat", "d_lon": "dest_lon", "t_o": "arrival_seconds"})
    kinds = {"stop_id": "string", "dest_stop_id": "string", "route_id": "string", "direction_id": "string",
             "hora_del_dia": "byte", "num_paradas_salto": "byte"}
    return p.select(*[F.col(c).cast(kinds.get(c, "float")).alias(c) for c in CLOCK_FEATURE_COLUMNS],
                    F.col("k").cast("int").alias("k"), *extra_cols)


def visits_by_split(raw: DataFrame, cfg: CityConfig, to_visits: Callable[[DataFrame], DataFrame],
                    raw_order=(), **rule) -> tuple[DataFrame, DataFrame]:
    """(train, test) visits in the city's ``stage_order``: a city that splits before it
    downsamples cuts its raw rows by ``raw_order`` (T3), so that no bin mixes the splits;
    the others cut visits (``split_visits`` with ``rule``)."""
    from ..operators import splits
    order = cfg.stage_order
    if "downsample" in order and order.index("split") < order.index("downsample"):
        if cfg.split != "rows" or not raw_order:
            raise ValueError("raw rows are split by their share in raw_order")
        d = splits.split_fraction(raw, list(raw_order), rule.get("frac", 0.8))
        return tuple(materialize(to_visits(d.where(F.col("split") == s).drop("split")), "visits") for s in ("train", "test"))
    v = to_visits(raw)
    if cfg.split in ("date", "year"):
        # the lags, the pairs and the search for hot entities each pass over the visits; the other rules write them
        v = materialize(v, "visits")
    v = split_visits(v, cfg, **rule)
    return tuple(v.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def split_visits(visits: DataFrame, cfg: CityConfig, cutoff: str | None = None, end: str | None = None,
                 frac: float = 0.8, year_train: int | None = None) -> DataFrame:
    """Apply the city's split rule and add ``split``:

    * ``date``  (T2): before ``cutoff`` train, from ``cutoff`` (and before ``end``) test;
    * ``rows``  (T3): the first ``floor(n * frac)`` visits by time are train;
    * ``trips`` (T4): entities ordered by first visit, the first ``frac`` of them train;
    * ``year``  (T5): visits of ``year_train`` are train, later years test.
    """
    from ..operators import splits
    ts = F.timestamp_micros("t_us")
    if cfg.split == "date":
        return splits.split_date(visits.withColumn("_ts", ts), "_ts", cutoff, end).drop("_ts")
    if cfg.split == "rows":
        return splits.split_fraction(visits, ["t_us", *cfg.entity, *cfg.order], frac)
    if cfg.split == "trips":
        return splits.split_fraction_by_entity(visits, list(cfg.entity), "t_us", frac)
    if cfg.split == "year":
        yr = F.year(ts)
        return visits.withColumn("split", F.when(yr == year_train, "train").when(yr > year_train, "test")) \
                     .where(F.col("split").isNotNull())
    raise ValueError(f"unknown split rule {cfg.split!r}")
