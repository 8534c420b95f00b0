"""DuckDB SQL oracles for ``event_queries`` (same names, same output columns)."""

from __future__ import annotations

K = 10
MAX_TT = 172800.0
CUTOFF = "2024-01-21"

EV = """ev AS (
  SELECT event_id, user_id, event_type, value, props, ts,
         user_id % 7 AS route_id, event_type AS stop_id,
         41 + CAST(event_id % 997 AS DOUBLE) / 10000 AS lat,
         28.9 + CAST(event_id % 991 AS DOUBLE) / 10000 AS lon,
         epoch_us(ts) AS t_us, epoch_us(ts) / 1e6 AS t
  FROM events)"""


def R4(x: str) -> str:
    return f"(floor(({x}) * 10000.0 + 0.5) / 10000.0)"


def hav(la1: str, lo1: str, la2: str, lo2: str) -> str:
    a = (f"(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * "
         f"pow(sin(radians({lo2} - {lo1}) / 2), 2))")
    return f"(6371000.0 * 2 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"


RN = f"""r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS rn FROM ev)"""

PAIRS_BOUNDED = f"""bp AS (
  SELECT o.event_id AS o_event_id, d.event_id AS d_event_id, d.rn - o.rn AS k,
         o.route_id, o.stop_id AS o_stop_id, d.stop_id AS d_stop_id, o.t AS o_t, d.t AS d_t, o.t_us AS o_t_us, d.t_us AS d_t_us,
         d.t_us - o.t_us AS tt_us, (d.t_us - o.t_us) / 1e6 AS tt, {hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS dist_m
  FROM r o JOIN r d ON o.user_id = d.user_id AND d.rn - o.rn BETWEEN 1 AND {K}
  WHERE d.t_us > o.t_us AND (d.t_us - o.t_us) / 1e6 > 0 AND (d.t_us - o.t_us) / 1e6 <= {MAX_TT})"""


def hist_sql(src: str, state_join: str = "", s0: str = "0", n0: str = "0") -> str:
    return f"""SELECT *, CASE WHEN ({n0}) + cnt = 0 THEN dist_m / 5.0
                        ELSE CAST(({s0}) + s AS DOUBLE) / (({n0}) + cnt) / 1e6 END AS hist_avg
  FROM (SELECT x.*, coalesce(sum(tt_us) OVER w, 0) AS s, count(tt_us) OVER w AS cnt
        FROM {src} x
        WINDOW w AS (PARTITION BY route_id, o_stop_id, d_stop_id ORDER BY k, o_t, o_event_id, d_event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) y {state_join}"""


ORACLES: dict[str, str] = {}

ORACLES["haversine_leg"] = f"""WITH {EV}
SELECT event_id, prev_event_id, {R4(hav('prev_lat', 'prev_lon', 'lat', 'lon'))} AS leg_m
FROM (SELECT *, lag(event_id) OVER w AS prev_event_id, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))"""

ORACLES["speed_lags"] = f"""WITH {EV},
legs AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS dist, t - lag(t) OVER w AS dt
         FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
v AS (SELECT *, CASE WHEN dt <> 0 THEN dist / dt END AS vel FROM legs)
SELECT event_id,
  {R4('coalesce(lag(vel, 1) OVER w, 0)')} AS vel_lag_1,
  {R4('coalesce(lag(vel, 2) OVER w, 0)')} AS vel_lag_2,
  {R4('coalesce(lag(vel, 3) OVER w, 0)')} AS vel_lag_3
FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)"""

ORACLES["od_pairs_bounded"] = f"""WITH {EV}, {RN}, {PAIRS_BOUNDED}
SELECT o_event_id, d_event_id, CAST(k AS BIGINT) AS k, tt, {R4('dist_m')} AS dist_m FROM bp"""

ORACLES["od_pairs_unbounded_count"] = f"""WITH {EV}, {RN}
SELECT CAST(d.rn - o.rn AS BIGINT) AS k, count(*) AS n_pairs
FROM r o JOIN r d ON o.user_id = d.user_id AND d.rn > o.rn
WHERE d.t_us > o.t_us AND (d.t_us - o.t_us) / 1e6 > 0 AND (d.t_us - o.t_us) / 1e6 <= {MAX_TT}
GROUP BY 1"""

ORACLES["expanding_mean_reference"] = f"""WITH {EV}, {RN}, {PAIRS_BOUNDED}
SELECT o_event_id, d_event_id, CAST(k AS BIGINT) AS k, {R4('hist_avg')} AS hist_avg
FROM ({hist_sql('bp')})"""

# --- state carried from train to test -------------------------------------------------
SPLIT_EV = f"""tr AS (SELECT * FROM ev WHERE ts < TIMESTAMP '{CUTOFF}'),
te AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '{CUTOFF}'),
rtr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS rn FROM tr),
rte AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS rn FROM te),
ptr AS (
  SELECT o.route_id, o.stop_id AS o_stop_id, d.stop_id AS d_stop_id, d.t_us - o.t_us AS tt_us
  FROM rtr o JOIN rtr d ON o.user_id = d.user_id AND d.rn - o.rn BETWEEN 1 AND {K}
  WHERE d.t_us > o.t_us AND (d.t_us - o.t_us) / 1e6 <= {MAX_TT}),
st AS (SELECT route_id, o_stop_id, d_stop_id, sum(tt_us) AS sum_tt_us, count(tt_us) AS n FROM ptr GROUP BY ALL),
pte AS (
  SELECT o.event_id AS o_event_id, d.event_id AS d_event_id, d.rn - o.rn AS k,
         o.route_id, o.stop_id AS o_stop_id, d.stop_id AS d_stop_id, o.t AS o_t, d.t AS d_t,
         d.t_us - o.t_us AS tt_us, {hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS dist_m
  FROM rte o JOIN rte d ON o.user_id = d.user_id AND d.rn > o.rn
  WHERE d.t_us > o.t_us AND (d.t_us - o.t_us) / 1e6 <= {MAX_TT})"""

ORACLES["expanding_mean_with_state"] = f"""WITH {EV}, {SPLIT_EV},
h AS (SELECT y.*, coalesce(st.sum_tt_us, 0) AS s0, coalesce(st.n, 0) AS n0
      FROM (SELECT x.*, coalesce(sum(tt_us) OVER w, 0) AS s, count(tt_us) OVER w AS cnt FROM pte x
            WINDOW w AS (PARTITION BY route_id, o_stop_id, d_stop_id ORDER BY k, o_t, o_event_id, d_event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) y
      LEFT JOIN st USING (route_id, o_stop_id, d_stop_id))
SELECT o_event_id, d_event_id, CAST(k AS BIGINT) AS k,
  {R4("CASE WHEN n0 + cnt = 0 THEN dist_m / 5.0 ELSE CAST(s0 + s AS DOUBLE) / (n0 + cnt) / 1e6 END")} AS hist_avg
FROM h"""

ORACLES["hist_state_merge"] = f"""WITH {EV}, {SPLIT_EV}
SELECT route_id, o_stop_id, d_stop_id, CAST(sum(s) AS BIGINT) AS sum_tt_us, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT route_id, o_stop_id, d_stop_id, sum_tt_us AS s, n FROM st
  UNION ALL
  SELECT route_id, o_stop_id, d_stop_id, sum(tt_us), count(tt_us) FROM pte GROUP BY ALL) GROUP BY ALL"""

ORACLES["expanding_mean_strict"] = f"""WITH {EV}, {RN}, {PAIRS_BOUNDED}
SELECT p.o_event_id, p.d_event_id, CAST(p.k AS BIGINT) AS k,
  {R4("CASE WHEN count(q.tt_us) = 0 THEN p.dist_m / 5.0 ELSE CAST(sum(q.tt_us) AS DOUBLE) / count(q.tt_us) / 1e6 END")} AS hist_avg
FROM bp p LEFT JOIN bp q ON p.route_id = q.route_id AND p.o_stop_id = q.o_stop_id AND p.d_stop_id = q.d_stop_id
  AND q.d_t < p.o_t
GROUP BY p.o_event_id, p.d_event_id, p.k, p.dist_m"""

# --- islands, sessions, legs, interpolation, fills -------------------------------------------
ORACLES["collapse_islands"] = f"""WITH {EV},
f AS (SELECT *, CASE WHEN lag(stop_id) OVER w IS NULL OR stop_id <> lag(stop_id) OVER w THEN 1 ELSE 0 END AS flag
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
i AS (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY t_us, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, arg_min(stop_id, t_us) AS stop_id,
       min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_rows
FROM i GROUP BY user_id, island"""

ORACLES["sessionize_gap"] = f"""WITH {EV},
f AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {12 * 3600} THEN 1 ELSE 0 END AS flag
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
i AS (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY t_us, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_events
FROM i GROUP BY user_id, session"""

ORACLES["next_leg"] = f"""WITH {EV}
SELECT event_id, next_event_id, next_stop_id, (next_t_us - t_us) / 1e6 AS leg_s FROM (
  SELECT *, lead(event_id) OVER w AS next_event_id, lead(stop_id) OVER w AS next_stop_id,
         lead(t_us) OVER w AS next_t_us
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)) WHERE next_event_id IS NOT NULL"""

GAPPY = """g AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v,
                  row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS rn FROM ev)"""

ORACLES["interpolate_linear"] = f"""WITH {EV}, {GAPPY},
y AS (SELECT *,
  last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr
  FROM g)
SELECT event_id, {R4("coalesce(v, CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((rn - pr) / (nr - pr)) END)")} AS value_interp
FROM y"""

ORACLES["ffill_bfill_slots"] = f"""WITH {EV},
per AS (SELECT floor(t_us / {600 * 1_000_000}) AS slot, max(value) AS reading FROM ev GROUP BY 1),
grid AS (SELECT unnest(range(CAST(min(slot) AS BIGINT), CAST(max(slot) AS BIGINT) + 1)) AS slot FROM per),
j AS (SELECT grid.slot, per.reading FROM grid LEFT JOIN per ON grid.slot = per.slot)
SELECT CAST(slot * {600 * 1_000_000} AS BIGINT) AS slot_us,
  coalesce(reading,
    last_value(reading IGNORE NULLS) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(reading IGNORE NULLS) OVER (ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS reading
FROM j"""

ORACLES["downsample_first"] = f"""WITH {EV}, {GAPPY}
SELECT user_id, epoch_us(date_trunc('hour', ts)) AS bin_us,
  arg_min(v, t_us) FILTER (WHERE v IS NOT NULL) AS first_value,
  arg_min(stop_id, t_us) AS first_stop_id
FROM g GROUP BY ALL"""

ORACLES["keep_first_distinct"] = f"""WITH {EV}
SELECT user_id, stop_id, arg_min(event_id, t_us) AS event_id, arg_min(value, t_us) AS value FROM ev GROUP BY ALL"""

# --- splits ------------------------------------------------------------------------------------
ORACLES["split_date"] = f"""WITH {EV}
SELECT event_id, CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM ev"""

ORACLES["split_fraction_rows"] = f"""WITH {EV}
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY t_us, event_id) <= floor(count(*) OVER () * 0.8)
                      THEN 'train' ELSE 'test' END AS split FROM ev"""

ORACLES["split_fraction_trips"] = f"""WITH {EV},
trips AS (SELECT user_id, CAST(ts AS DATE) AS day, min(t_us) AS start FROM ev GROUP BY ALL),
lab AS (SELECT user_id, day, CASE WHEN row_number() OVER (ORDER BY start, user_id, day) <= floor(count(*) OVER () * 0.8)
                                   THEN 'train' ELSE 'test' END AS split FROM trips)
SELECT ev.event_id, lab.split FROM ev JOIN lab ON ev.user_id = lab.user_id AND CAST(ev.ts AS DATE) = lab.day"""
