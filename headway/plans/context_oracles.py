"""DuckDB SQL oracles for ``context_queries`` (same names, same output columns)."""

from __future__ import annotations

from .event_oracles import EV, GAPPY, K, MAX_TT, PAIRS_BOUNDED, R4, RN, hav, hist_sql

HOLI = "(DATE '2024-01-01', DATE '2024-01-15')"
ONE, ZERO = "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"

PAIRS_UNBOUNDED = f"""up AS (
  SELECT o.event_id AS o_event_id, d.event_id AS d_event_id, d.rn - o.rn AS k,
         o.route_id, o.stop_id AS o_stop_id, d.stop_id AS d_stop_id, o.t AS o_t, d.t AS d_t,
         d.t_us - o.t_us AS tt_us, (d.t_us - o.t_us) / 1e6 AS tt, {hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS dist_m
  FROM r o JOIN r d ON o.user_id = d.user_id AND d.rn > o.rn
  WHERE d.t_us > o.t_us AND (d.t_us - o.t_us) / 1e6 <= {MAX_TT})"""

SCORED_B = f"{EV}, {RN}, {PAIRS_BOUNDED}, h AS ({hist_sql('bp')})"
SCORED_U = f"{EV}, {RN}, {PAIRS_UNBOUNDED}, h AS ({hist_sql('up')})"

ORACLES: dict[str, str] = {}

ORACLES["dim_join_roles"] = """
SELECT l.l_orderkey, l.l_linenumber, cn.n_name AS cust_nation, sn.n_name AS supp_nation
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey"""

ORACLES["baseline_join"] = f"""WITH li AS (SELECT *, year(l_shipdate) AS yr FROM lineitem),
b AS (SELECT l_returnflag, l_linestatus, yr + 1 AS yr, sum(l_quantity) / count(*) AS baseline_qty
      FROM li GROUP BY l_returnflag, l_linestatus, yr)
SELECT l_orderkey, l_linenumber, {R4('coalesce(b.baseline_qty, 0.0)')} AS baseline_qty
FROM li LEFT JOIN b USING (l_returnflag, l_linestatus, yr)"""

ORACLES["weather_hour_join"] = f"""WITH {EV},
w AS (SELECT date_trunc('hour', ts) AS hour_key, max(value) AS temperature_2m,
             CAST(count(*) AS DOUBLE) / 10 AS precipitation FROM ev GROUP BY 1)
SELECT event_id, w.temperature_2m, coalesce(w.precipitation, {ZERO}) AS precipitation
FROM ev LEFT JOIN w ON date_trunc('hour', ev.ts - INTERVAL 1 HOUR) = w.hour_key"""

ORACLES["calendar_unroll"] = """WITH svc AS (
  SELECT n_nationkey AS service_id, CAST(DATE '2024-01-01' + CAST(n_nationkey % 10 AS INTEGER) AS DATE) AS s,
         CAST(DATE '2024-01-01' + CAST(n_nationkey % 10 AS INTEGER) + 20 AS DATE) AS e FROM nation),
days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15', INTERVAL 1 DAY)) AS DATE) AS d),
active AS (SELECT service_id, d FROM svc, days WHERE d BETWEEN s AND e AND (service_id + isodow(d) - 1) % 3 <> 0)
SELECT CAST(o.o_orderkey AS VARCHAR) || '_' || strftime(a.d, '%Y%m%d') AS trip_date_id, o.o_orderkey,
       strftime(a.d, '%Y-%m-%d') AS service_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN active a ON a.service_id = c.c_nationkey"""

ORACLES["holiday_flag"] = f"""SELECT event_id, CASE WHEN CAST(ts AS DATE) IN {HOLI} THEN {ONE} ELSE {ZERO} END AS is_holiday
FROM events"""

ORACLES["calendar_features"] = f"""WITH x AS (
  SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM events)
SELECT event_id, CAST(hour(lt) AS BIGINT) AS hora_del_dia, CAST(isodow(lt) - 1 AS BIGINT) AS dia_semana,
       CAST(month(lt) AS BIGINT) AS mes,
       CASE WHEN CAST(lt AS DATE) IN {HOLI} THEN {ONE} ELSE {ZERO} END AS is_holiday FROM x"""


def _metric_cols(src: str, by: str = "") -> str:
    e = "(hist_avg - tt)"
    sst = "(sum(tt * tt) - count(*) * pow(sum(tt) / count(*), 2))"
    return f"""count(*) AS n, {R4(f'sum(abs({e})) / count(*)')} AS mae,
  {R4(f'sqrt(sum({e} * {e}) / count(*))')} AS rmse,
  {R4(f'CASE WHEN {sst} > 0 THEN 1 - sum({e} * {e}) / {sst} ELSE 0.0 END')} AS r2"""


ORACLES["metrics_global"] = f"""WITH {SCORED_B}
SELECT {_metric_cols('h')} FROM h"""

ORACLES["metrics_by_k"] = f"""WITH {SCORED_U},
m AS (SELECT CAST(k AS BIGINT) AS k, {_metric_cols('h')} FROM h GROUP BY k)
SELECT k, n, mae, rmse, r2, {R4('CAST(n AS DOUBLE) / sum(n) OVER ()')} AS share,
       CASE WHEN k <= 3 THEN 'direct' ELSE 'chained' END AS mode FROM m"""

ORACLES["mape_nonzero"] = f"""WITH {SCORED_B}
SELECT {R4('coalesce(avg(CASE WHEN tt <> 0 THEN abs((tt - hist_avg) / tt) END) * 100.0, 0.0)')} AS mape,
       count(CASE WHEN tt <> 0 THEN 1 END) AS n_nonzero FROM h"""

ORACLES["chained_prediction"] = f"""WITH {SCORED_U},
s AS (SELECT *, CASE WHEN k <= 3 THEN [CAST(k AS BIGINT)]
                     ELSE list_transform(range(m), lambda i: base + CASE WHEN i < rem THEN 1 ELSE 0 END) END AS segs
      FROM (SELECT *, (k + 2) // 3 AS m, k // ((k + 2) // 3) AS base, k % ((k + 2) // 3) AS rem FROM h)),
x AS (SELECT o_event_id, d_event_id, k, hist_avg, len(segs) AS n_segments, unnest(segs) AS seg FROM s)
SELECT o_event_id, d_event_id, CAST(k AS BIGINT) AS k, CAST(n_segments AS BIGINT) AS n_segments,
  {R4('sum(30.0 * sqrt(CAST(CASE WHEN k <= 3 THEN k ELSE seg END AS DOUBLE)) + 0.9 * CASE WHEN k <= 3 THEN hist_avg ELSE hist_avg * (CAST(seg AS DOUBLE) / k) END)')} AS yhat
FROM x GROUP BY o_event_id, d_event_id, k, n_segments"""

ORACLES["confidence_score"] = f"""WITH {EV},
x AS (SELECT event_id, hour(ts) AS h, isodow(ts) - 1 AS d, (lead(t_us) OVER w - t_us) / 1e6 AS e,
             value / 10.0 AS p, value / 20.0 AS s
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))
SELECT event_id, CAST(round(greatest(0.10, least(0.99,
    0.75 - CASE WHEN h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 19 THEN 0.12 ELSE 0 END
         + CASE WHEN e < 60 THEN 0.10 WHEN e > 900 THEN -0.10 ELSE 0 END
         - CASE WHEN d >= 5 THEN 0.05 ELSE 0 END
         - CASE WHEN p > 5 THEN 0.10 WHEN p > 1 THEN 0.05 ELSE 0 END
         - CASE WHEN s > 2 THEN 0.15 WHEN s > 0.5 THEN 0.08 ELSE 0 END)), 2) AS DOUBLE) AS confidence
FROM x"""

ORACLES["gtfs_time_parse"] = f"""WITH {EV},
c AS (SELECT event_id, CASE
        WHEN event_id % 11 = 0 THEN CAST(event_id % 30 AS VARCHAR) || ':' || CAST(event_id % 60 AS VARCHAR)
        WHEN event_id % 13 = 0 THEN 'xx:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':00'
        ELSE lpad(CAST(event_id % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')
             || ':' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') END AS clock FROM ev),
p AS (SELECT event_id, clock, string_split(trim(clock), ':') AS parts FROM c)
SELECT event_id, clock, CASE WHEN len(parts) = 3 AND TRY_CAST(parts[1] AS INTEGER) IS NOT NULL
       AND TRY_CAST(parts[2] AS INTEGER) IS NOT NULL AND TRY_CAST(parts[3] AS INTEGER) IS NOT NULL
  THEN CAST(parts[1] AS BIGINT) * 3600 + CAST(parts[2] AS BIGINT) * 60 + CAST(parts[3] AS BIGINT) END AS seconds
FROM p"""

ORACLES["coord_repair"] = f"""WITH {EV},
r AS (SELECT event_id, CASE
        WHEN event_id % 13 = 0 THEN '4'
        WHEN event_id % 7 = 0 THEN '41.' || CAST(event_id % 1000 AS VARCHAR) || '.' || CAST(event_id % 97 AS VARCHAR)
        WHEN event_id % 5 = 0 THEN '-' || CAST(410000 + event_id % 9973 AS VARCHAR)
        ELSE CAST(410000 + event_id % 9973 AS VARCHAR) END AS raw FROM ev),
d AS (SELECT event_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM r)
SELECT event_id, raw, CASE WHEN length(digits) >= 2
  THEN TRY_CAST(substr(digits, 1, 2) || '.' || substr(digits, 3) AS DOUBLE) END AS coord FROM d"""

ORACLES["props_json"] = """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS prop_k FROM events"""

ORACLES["polyline_points"] = f"""WITH {EV}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS point_seq, lat, lon FROM ev"""

ORACLES["centroid"] = f"""WITH {EV},
e AS (SELECT user_id, CAST(round(lat * 10000) AS BIGINT) AS a, CAST(round(lon * 10000) AS BIGINT) AS b FROM ev)
SELECT user_id, {R4('CAST(sum(a) AS DOUBLE) / count(a) / 10000.0')} AS center_lat,
       {R4('CAST(sum(b) AS DOUBLE) / count(b) / 10000.0')} AS center_lon FROM e GROUP BY user_id"""

ORACLES["schedule_vs_model"] = f"""WITH {SCORED_B},
x AS (SELECT *, (floor(d_t_us / 300000000) * 300000000 - floor(o_t_us / 300000000) * 300000000) / 1e6 AS sdiff FROM h),
y AS (SELECT *, CASE WHEN sdiff > 0 THEN sdiff ELSE dist_m / (CAST(15000 AS DOUBLE) / 3600) END AS sched_s,
             greatest(CAST(30 AS DOUBLE), hist_avg) AS predicted_s FROM x),
z AS (SELECT *, abs(sched_s - tt) AS es, abs(predicted_s - tt) AS em FROM y)
SELECT o_event_id, d_event_id, CAST(greatest(1, least(10, k)) AS BIGINT) AS hops,
  {R4('sched_s')} AS sched_s, {R4('predicted_s')} AS predicted_s, {R4('es / 60.0')} AS error_sched_min,
  {R4('em / 60.0')} AS error_model_min, {R4('(es - em) / greatest(es, 0.01) * 100.0')} AS improvement_pct,
  em <= es AS model_wins
FROM z"""

ORACLES["od_pairs_legs"] = f"""WITH {EV},
legs AS (SELECT *, lead(event_id) OVER w AS next_event_id, lead(t_us) OVER w AS next_t_us
         FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS rn
      FROM legs WHERE next_event_id IS NOT NULL)
SELECT o.event_id AS o_event_id, d.next_event_id AS d_event_id, CAST(d.rn - o.rn AS BIGINT) AS k,
       (d.next_t_us - o.t_us) / 1e6 AS tt
FROM l o JOIN l d ON o.user_id = d.user_id AND d.rn - o.rn BETWEEN 1 AND {K}
WHERE (d.next_t_us - o.t_us) / 1e6 > 0 AND (d.next_t_us - o.t_us) / 1e6 <= {MAX_TT}"""

ORACLES["quality_report"] = f"""WITH {EV}, {GAPPY}
SELECT 'event_id' AS column_name, count(*) FILTER (WHERE event_id IS NULL) AS n_null FROM g
UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM g
UNION ALL SELECT 'stop_id', count(*) FILTER (WHERE stop_id IS NULL) FROM g
UNION ALL SELECT 'v', count(*) FILTER (WHERE v IS NULL) FROM g"""

ORACLES["distinct_counts"] = f"""WITH {EV}
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT stop_id) AS n_stops,
       count(DISTINCT CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS n_user_days,
       min(t_us) AS min_t_us, max(t_us) AS max_t_us FROM ev"""

ARRIVALS = """a AS (SELECT l_orderkey, l_linenumber, l_suppkey AS stop_id, l_partkey % 10 AS line_id,
  l_returnflag AS traffic_level, l_linestatus AS weather_condition, isodow(l_shipdate) - 1 AS day_of_week,
  l_shipdate AS actual_arrival, l_tax * 100 AS cumulative_delay_min, l_discount * 100 AS delay_min,
  l_quantity AS passengers_waiting FROM lineitem)"""

ORACLES["delay_features"] = f"""WITH {ARRIVALS},
s AS (SELECT s_suppkey AS stop_id, s_acctbal / 1000.0 AS distance_from_prev_km FROM supplier)
SELECT l_orderkey, l_linenumber, CAST(coalesce(s.distance_from_prev_km, 0.0) AS FLOAT) AS distance_from_prev_km,
       CAST(delay_min AS FLOAT) AS delay_min,
       CASE WHEN actual_arrival < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split
FROM a LEFT JOIN s USING (stop_id)
WHERE actual_arrival < TIMESTAMP '2001-01-01' AND cumulative_delay_min IS NOT NULL AND delay_min IS NOT NULL
  AND traffic_level IS NOT NULL AND weather_condition IS NOT NULL AND line_id IS NOT NULL AND stop_id IS NOT NULL"""

ORACLES["crowd_features"] = f"""WITH {ARRIVALS},
a2 AS (SELECT * REPLACE (stop_id % 50 AS stop_id) FROM a),
f AS (SELECT o_custkey % 50 AS stop_id, o_orderkey % 10 AS line_id, o_custkey % 3 AS hour_of_day, isodow(o_orderdate) - 1 AS day_of_week,
             CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS weather_condition,
             o_totalprice / 1000.0 AS v, o_orderkey FROM orders),
fd AS (SELECT stop_id, line_id, hour_of_day, day_of_week, weather_condition, arg_min(v, o_orderkey) AS avg_passengers_waiting
       FROM f GROUP BY ALL)
SELECT l_orderkey, l_linenumber, {R4('coalesce(fd.avg_passengers_waiting, 0.0)')} AS avg_passengers_waiting,
       hour_of_day, stop_type, passengers_waiting,
       CASE WHEN actual_arrival < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, l_linenumber % 3 AS hour_of_day, weather_condition || traffic_level AS stop_type FROM a2)
LEFT JOIN fd USING (stop_id, line_id, hour_of_day, day_of_week, weather_condition)
WHERE passengers_waiting IS NOT NULL"""

GTFS = """svc AS (
  SELECT n_nationkey AS service_id, CAST(DATE '2024-01-01' + CAST(n_nationkey % 10 AS INTEGER) AS DATE) AS s,
         CAST(DATE '2024-01-01' + CAST(n_nationkey % 10 AS INTEGER) + 20 AS DATE) AS e FROM nation),
days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08', INTERVAL 1 DAY)) AS DATE) AS d),
active AS (SELECT service_id, d FROM svc, days WHERE d BETWEEN s AND e AND (service_id + isodow(d) - 1) % 3 <> 0),
trips AS (SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, c_nationkey AS service_id
          FROM orders JOIN customer ON o_custkey = c_custkey),
st AS (SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, l_linenumber AS seq, CAST(l_suppkey AS VARCHAR) AS stop_id,
              (20 + l_linenumber) * 3600 + (l_partkey % 60) * 60 AS arr_s FROM lineitem),
stops AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id,
                 CASE WHEN s_suppkey % 23 <> 0 THEN 40 + s_acctbal / 10000 END AS lat FROM supplier)"""

ORACLES["schedule_legs"] = f"""WITH {GTFS},
u AS (SELECT t.trip_id || '_' || strftime(a.d, '%Y%m%d') AS trip_date_id, st.seq, st.stop_id,
             epoch_us(CAST(a.d AS TIMESTAMP)) + (st.arr_s + 30) * 1000000 AS dep_us,
             epoch_us(CAST(a.d AS TIMESTAMP)) + st.arr_s * 1000000 AS arr_us
      FROM active a JOIN trips t ON t.service_id = a.service_id JOIN st ON st.trip_id = t.trip_id),
l AS (SELECT u.*, stops.lat AS lat_o, lead(u.stop_id) OVER w AS stop_id_destino, lead(u.arr_us) OVER w AS next_arr,
             lead(u.seq) OVER w AS next_seq
      FROM u LEFT JOIN stops ON u.stop_id = stops.stop_id
      WINDOW w AS (PARTITION BY trip_date_id ORDER BY seq, dep_us, u.stop_id))
SELECT trip_date_id, stop_id AS stop_id_origen, stop_id_destino, dep_us, next_arr AS arr_us,
       (next_arr - dep_us) / 1e6 AS tiempo_viaje_base, lat_o
FROM l WHERE next_seq IS NOT NULL AND (next_arr - dep_us) / 1e6 > 0"""

ORACLES["schedule_expansion"] = """WITH st AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_suppkey AS VARCHAR) AS stop_id,
         (20 + l_linenumber) * 3600 + (l_partkey % 60) * 60 AS sec FROM lineitem),
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, CASE WHEN s_suppkey % 23 <> 0 THEN 40 + s_acctbal / 10000 END AS lat,
             -3 - s_nationkey / 100.0 AS lon FROM supplier),
t AS (SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, o_orderpriority AS route_id,
             CASE WHEN o_orderstatus <> 'P' THEN '1' ELSE '0' END AS direction_id FROM orders),
days AS (SELECT unnest(range(0, 3)) AS di)
SELECT st.trip_id AS vehicle_id, t.route_id, t.direction_id, st.stop_id AS current_stop_id,
       s.lat AS current_lat, s.lon AS current_lon, CAST(1704672000 + di * 86400 + sec AS BIGINT) AS timestamp
FROM st JOIN s ON st.stop_id = s.stop_id LEFT JOIN t ON st.trip_id = t.trip_id, days
WHERE s.lat IS NOT NULL AND s.lon IS NOT NULL"""

ORACLES["row_index"] = f"""WITH {EV}
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS row_in_entity FROM ev"""


def _split_visits(name: str, cond: str) -> str:
    """Visits of one split with per-user speed lags (lags never cross the split)."""
    return f"""{name}_v AS (SELECT * FROM ev WHERE {cond}),
{name}_l AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS _dist, t - lag(t) OVER w AS _dt
             FROM {name}_v WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
{name}_s AS (SELECT *, CASE WHEN _dt <> 0 THEN _dist / _dt END AS _vel FROM {name}_l),
{name} AS (SELECT *, coalesce(lag(_vel, 1) OVER w, 0) AS vel_lag_1, coalesce(lag(_vel, 2) OVER w, 0) AS vel_lag_2,
                  coalesce(lag(_vel, 3) OVER w, 0) AS vel_lag_3,
                  row_number() OVER w - 1 AS rn
           FROM {name}_s WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))"""


ORACLES["od_features"] = f"""WITH {EV},
{_split_visits('trv', f"ts < TIMESTAMP '2024-01-21'")},
{_split_visits('tev', f"ts >= TIMESTAMP '2024-01-21'")},
ptr AS (SELECT CAST(o.route_id AS VARCHAR) AS route_id, o.stop_id AS o_stop, d.stop_id AS d_stop, d.t_us - o.t_us AS tt_us
        FROM trv o JOIN trv d ON o.user_id = d.user_id AND d.rn - o.rn BETWEEN 1 AND {K}
        WHERE d.t_us > o.t_us AND (d.t_us - o.t_us) / 1e6 <= {MAX_TT}),
st AS (SELECT route_id, o_stop, d_stop, sum(tt_us) AS s0, count(*) AS n0 FROM ptr GROUP BY ALL),
pte AS (SELECT CAST(o.route_id AS VARCHAR) AS route_id, o.stop_id AS o_stop, d.stop_id AS d_stop, d.rn - o.rn AS k,
               o.t AS t_o, o.t_us AS t_o_us, o.ts AS ts_o, d.t_us - o.t_us AS tt_us,
               {hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS dist, o.vel_lag_1, o.vel_lag_2, o.vel_lag_3
        FROM tev o JOIN tev d ON o.user_id = d.user_id AND d.rn > o.rn
        WHERE d.t_us > o.t_us AND (d.t_us - o.t_us) / 1e6 <= {MAX_TT}),
h AS (SELECT y.*, coalesce(st.s0, 0) AS s0, coalesce(st.n0, 0) AS n0
      FROM (SELECT x.*, coalesce(sum(tt_us) OVER w, 0) AS s, count(tt_us) OVER w AS cnt FROM pte x
            WINDOW w AS (PARTITION BY route_id, o_stop, d_stop ORDER BY k, t_o, t_o_us, d_stop
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) y
      LEFT JOIN st USING (route_id, o_stop, d_stop)),
w AS (SELECT date_trunc('hour', ts) AS hour_key, max(value) AS temperature_2m,
             CAST(count(*) AS DOUBLE) / 10 AS precipitation FROM ev GROUP BY 1),
f AS (SELECT h.*, timezone('America/New_York', timezone('UTC', ts_o)) AS lt, w.temperature_2m, w.precipitation
      FROM h LEFT JOIN w ON date_trunc('hour', h.ts_o) = w.hour_key)
SELECT CAST(tt_us / 1e6 AS FLOAT) AS tiempo_viaje_segundos, CAST(hour(lt) AS TINYINT) AS hora_del_dia,
       CAST(isodow(lt) - 1 AS TINYINT) AS dia_semana, CAST(month(lt) AS TINYINT) AS mes,
       CAST(temperature_2m AS FLOAT) AS temperature_2m, CAST(coalesce(precipitation, 0) AS FLOAT) AS precipitation,
       CAST(0 AS FLOAT) AS snowfall,
       CAST(CASE WHEN CAST(lt AS DATE) IN {HOLI} THEN 1 ELSE 0 END AS FLOAT) AS is_holiday,
       route_id, '0' AS direction_id, o_stop AS stop_id_origen, d_stop AS stop_id_destino,
       CAST(dist AS FLOAT) AS distancia_proyectada, CAST(vel_lag_1 AS FLOAT) AS vel_lag_1,
       CAST(vel_lag_2 AS FLOAT) AS vel_lag_2, CAST(vel_lag_3 AS FLOAT) AS vel_lag_3,
       CAST(k AS FLOAT) AS num_paradas_salto,
       CAST(CASE WHEN n0 + cnt = 0 THEN dist / 5.0 ELSE CAST(s0 + s AS DOUBLE) / (n0 + cnt) / 1e6 END AS FLOAT)
         AS tiempo_promedio_historico,
       CAST(k AS INTEGER) AS k
FROM f"""

ORACLES["leg_log_trips"] = f"""WITH {EV},
legs AS (SELECT user_id AS vehicle_id, CAST(user_id % 7 AS VARCHAR) AS route_id, stop_id AS o,
                lead(stop_id) OVER w AS d, t_us AS dep, lead(t_us) OVER w AS arr, lead(event_id) OVER w AS nxt
         FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
l2 AS (SELECT * FROM legs WHERE nxt IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(o) OVER w IS NULL OR route_id <> lag(route_id) OVER w OR o <> lag(o) OVER w
                          OR d <> lag(d) OVER w THEN 1 ELSE 0 END AS flag
      FROM l2 WINDOW w AS (PARTITION BY vehicle_id ORDER BY dep, arr, o)),
i AS (SELECT *, sum(flag) OVER (PARTITION BY vehicle_id ORDER BY dep, arr, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                AS island FROM f),
c AS (SELECT vehicle_id, island, min(dep) AS dep, max(arr) AS arr, arg_min(route_id, dep) AS route_id,
             arg_min(o, dep) AS o, arg_min(d, dep) AS d FROM i GROUP BY vehicle_id, island),
c2 AS (SELECT * FROM c WHERE (arr - dep) / 1e6 >= 30),
t AS (SELECT *, CASE WHEN lag(dep) OVER w IS NULL OR route_id <> lag(route_id) OVER w
                          OR dep / 1e6 - lag(arr) OVER w / 1e6 > 900 OR o <> lag(d) OVER w THEN 1 ELSE 0 END AS flag
      FROM c2 WINDOW w AS (PARTITION BY vehicle_id ORDER BY dep, arr, o))
SELECT vehicle_id, dep AS dep_us, arr AS arr_us, o AS stop_id_origen, d AS stop_id_destino,
       CAST(sum(flag) OVER (PARTITION BY vehicle_id ORDER BY dep, arr, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS trip_no
FROM t"""


ORACLES["schedule_leg_lags"] = f"""WITH {GTFS},
pos AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, CASE WHEN s_suppkey % 23 <> 0 THEN 40 + s_acctbal / 10000 END AS lat,
               -3 - s_nationkey / 100.0 AS lon FROM supplier),
u AS (SELECT t.trip_id || '_' || strftime(a.d, '%Y%m%d') AS trip_date_id, st.seq, st.stop_id,
             epoch_us(CAST(a.d AS TIMESTAMP)) + (st.arr_s + 30) * 1000000 AS dep_us,
             epoch_us(CAST(a.d AS TIMESTAMP)) + st.arr_s * 1000000 AS arr_us
      FROM active a JOIN trips t ON t.service_id = a.service_id JOIN st ON st.trip_id = t.trip_id),
l AS (SELECT trip_date_id, stop_id AS stop_id_origen, dep_us, seq, lead(stop_id) OVER w AS stop_id_destino,
             lead(arr_us) OVER w AS arr_us, lead(seq) OVER w AS next_seq
      FROM u WINDOW w AS (PARTITION BY trip_date_id ORDER BY seq, dep_us, stop_id)),
g AS (SELECT l.*, CAST(CAST({hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS FLOAT) AS DOUBLE) / ((arr_us - dep_us) / 1e6) AS speed
      FROM l JOIN pos o ON o.stop_id = stop_id_origen JOIN pos d ON d.stop_id = stop_id_destino
      WHERE next_seq IS NOT NULL AND arr_us > dep_us AND o.lat IS NOT NULL AND d.lat IS NOT NULL)
SELECT trip_date_id, stop_id_origen, stop_id_destino, dep_us,
       round(CAST(coalesce(CAST(lag(speed, 1) OVER w AS FLOAT), 0) AS DOUBLE), 2) AS vel_lag_1,
       round(CAST(coalesce(CAST(lag(speed, 2) OVER w AS FLOAT), 0) AS DOUBLE), 2) AS vel_lag_2,
       round(CAST(coalesce(CAST(lag(speed, 3) OVER w AS FLOAT), 0) AS DOUBLE), 2) AS vel_lag_3
FROM g WINDOW w AS (PARTITION BY trip_date_id ORDER BY dep_us, arr_us, stop_id_origen, stop_id_destino)"""

ORACLES["route_requests"] = f"""WITH {EV}, {RN}, {PAIRS_BOUNDED},
tp AS (SELECT o_orderpriority AS route_id, min(CAST(o_orderkey AS VARCHAR)) AS trip_id
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
onr AS (SELECT tp.route_id, l_linenumber AS seq, (20 + l_linenumber) * 3600 + (l_partkey % 60) * 60 AS sched,
               CAST(s_suppkey AS VARCHAR) AS stop_id, s_name AS name,
               CASE WHEN s_suppkey % 23 <> 0 THEN 40 + s_acctbal / 10000 END AS lat, -3 - s_nationkey / 100.0 AS lon
        FROM tp JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = tp.trip_id JOIN supplier ON s_suppkey = l_suppkey),
pl AS (SELECT route_id, seq, name FROM (SELECT *, row_number() OVER (PARTITION BY route_id, seq ORDER BY stop_id) AS i FROM onr)
       WHERE i = 1),
att AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id, name ORDER BY seq, sched, stop_id) AS i FROM onr
                       WHERE substr(route_id, 1, 1) IN ('1', '3', '5')) WHERE i = 1),
ask AS (SELECT event_id AS request_id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][user_id % 5 + 1] AS route_id,
               event_id % 3 + 1 AS op, event_id % 7 + 1 AS dp, hour(ts) AS h, ['Clear', 'Rain', 'Snow'][event_id % 3 + 1] AS weather,
               [0.0, 12.0, 5.0][event_id % 3 + 1] AS prec FROM ev),
rq AS (SELECT ask.*, a.name AS o_name, b.name AS d_name FROM ask LEFT JOIN pl a ON ask.route_id = a.route_id AND op = a.seq
       LEFT JOIN pl b ON ask.route_id = b.route_id AND dp = b.seq),
ends AS (SELECT rq.*, o.seq AS o_seq, d.seq AS d_seq, d.sched - o.sched AS sdiff, {hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS dist
         FROM rq LEFT JOIN att o ON o.route_id = rq.route_id AND o.name = o_name
         LEFT JOIN att d ON d.route_id = rq.route_id AND d.name = d_name),
v AS (SELECT *, CASE WHEN o_seq IS NULL OR d_seq IS NULL THEN 'unknown_stop' WHEN d_seq <= o_seq THEN 'destination_not_after_origin' END
             AS reject_reason FROM ends),
kn AS (SELECT k, tt, dist_m, row_number() OVER (PARTITION BY k ORDER BY md5(o_event_id || '-' || d_event_id)) - 1 AS i,
              count(*) OVER (PARTITION BY k) AS n FROM bp),
sz AS (SELECT k, max(n) AS n FROM kn GROUP BY k),
w AS (SELECT v.*, coalesce(sz.k, 5) AS hop,
             CAST('0x' || substr(md5(v.route_id || '|' || o_name || '|' || d_name || '|' || h || '|' || weather), 1, 8) AS BIGINT)
             % coalesce(sz.n, (SELECT n FROM sz WHERE k = 5)) AS i
      FROM v LEFT JOIN sz ON sz.k = greatest(1, least(10, d_seq - o_seq)) WHERE reject_reason IS NULL),
x AS (SELECT w.*, kn.tt * (dist / greatest(kn.dist_m, 1.0)) AS actual_s,
             CASE WHEN sdiff > 0 THEN CAST(sdiff AS DOUBLE) ELSE dist / (CAST(15000 AS DOUBLE) / 3600) END AS sched_s,
             CASE WHEN dist IS NOT NULL THEN greatest(30.0, dist / 6.0 + 20.0 * prec) ELSE 30.0 END AS predicted_s
      FROM w JOIN kn ON kn.k = w.hop AND kn.i = w.i),
z AS (SELECT *, abs(sched_s - actual_s) AS es, abs(predicted_s - actual_s) AS em FROM x)
SELECT request_id, TRUE AS is_valid, CAST(NULL AS VARCHAR) AS reject_reason, CAST(d_seq - o_seq AS BIGINT) AS stops,
       {R4('actual_s')} AS actual_s, {R4('dist / greatest(actual_s, 1.0)')} AS velocity_m_s, {R4('sched_s')} AS sched_s,
       {R4('CAST(predicted_s AS DOUBLE)')} AS predicted_s, {R4('(es - em) / greatest(es, 0.01) * 100.0')} AS improvement_pct,
       em <= es AS model_wins FROM z
UNION ALL SELECT request_id, FALSE, reject_reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v WHERE reject_reason IS NOT NULL"""

ORACLES["quality_by_split"] = f"""WITH {EV}, {GAPPY},
legs AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS dist, t - lag(t) OVER w AS dt
         FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
s AS (SELECT *, CASE WHEN dt <> 0 THEN dist / dt END AS vel FROM legs),
f AS (SELECT *, coalesce(lag(vel, 1) OVER w, 0) AS l1, coalesce(lag(vel, 3) OVER w, 0) AS l3 FROM s
      WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))
SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
       count(*) FILTER (WHERE v IS NULL) AS null_v, count(*) FILTER (WHERE stop_id IS NULL) AS null_stop_id,
       count(*) FILTER (WHERE l1 <> 0) AS nonzero_vel_lag_1, count(*) FILTER (WHERE l3 <> 0) AS nonzero_vel_lag_3
FROM f GROUP BY 1"""

ORACLES["ids_and_clocks"] = f"""WITH {EV},
l AS (SELECT *, timezone('America/New_York', timezone('UTC', make_timestamp(CAST(floor(t_us / 1e6) AS BIGINT) * 1000000))) AS lt
      FROM ev)
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS vehicle_id,
       CAST(route_id AS VARCHAR) || ' | ' || stop_id AS label, strftime(lt, '%Y-%m-%d %H:%M:%S') AS local_time,
       CAST(hour(lt) * 3600 + minute(lt) * 60 + second(lt) AS BIGINT) AS second_of_day FROM l"""

ORACLES["tables_on_disk"] = f"""WITH {EV}
SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_date, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split
FROM ev WHERE ts >= TIMESTAMP '2024-01-08'"""


ORACLES["snap_stops"] = f"""WITH {EV},
st AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, 41 + CAST(s_suppkey * 7919 % 9973 AS DOUBLE) / 99730.0 AS slat,
              28.9 + CAST(s_suppkey * 104729 % 9967 AS DOUBLE) / 99670.0 AS slon FROM supplier),
near AS (SELECT event_id, stop_id, m FROM (SELECT event_id, st.stop_id, {hav('lat', 'lon', 'slat', 'slon')} AS m FROM ev, st)
         WHERE m <= 400 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY m, stop_id) = 1)
SELECT ev.event_id, coalesce(near.stop_id, 'SNAPPED_UNKNOWN') AS stop_id, CAST(floor(m * 100 + 0.5) AS BIGINT) AS snap_cm
FROM ev LEFT JOIN near ON near.event_id = ev.event_id"""

_PARTS = f"""WITH {EV}, {RN}, {PAIRS_BOUNDED}"""
ORACLES["horizon_parts"] = f"""{_PARTS}
SELECT k, count(*) AS n, {R4('sum(tt)')} AS tt FROM bp GROUP BY k"""

ORACLES["tolerant_parts"] = f"""{_PARTS},
per AS (SELECT k, count(*) AS n FROM bp GROUP BY k)
SELECT CAST(k AS VARCHAR) AS part, CAST(NULL AS VARCHAR) AS reason, n FROM per
UNION ALL SELECT '11', 'no readable footer, or no rows', 1
UNION ALL SELECT 'eleven', 'part name', 1
UNION ALL SELECT '12', 'too short', 1"""

ORACLES["stops_by_encoding"] = """SELECT CAST(s_suppkey AS VARCHAR) AS stop_id,
  CASE s_suppkey % 4 WHEN 0 THEN 'Kızılay Şubesi ' WHEN 1 THEN 'Çayırbaşı İğde ' WHEN 2 THEN 'Ümraniye Göztepe ' ELSE 'Şişli � Ğ ' END
  || s_suppkey AS stop_name, CASE s_suppkey % 4 WHEN 3 THEN 'utf-8' WHEN 2 THEN 'utf-8' ELSE 'iso-8859-9' END AS encoding FROM supplier"""


def unit_hash(*keys: str) -> str:
    """The number in [0, 1) of ``splits.unit_hash`` with its default seed."""
    text = " || '|' || ".join(["'42'", *[f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / 281474976710656.0)"


ORACLES["stratified_sample"] = f"""{_PARTS}
SELECT o_event_id, d_event_id, k FROM bp WHERE {unit_hash('k', 'o_event_id', 'd_event_id')} < 0.05"""

ORACLES["sample_entities"] = f"""WITH {EV},
chosen AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM ev WHERE user_id IS NOT NULL)
           ORDER BY {unit_hash('user_id')}, user_id LIMIT 10)
SELECT event_id, user_id FROM ev JOIN chosen USING (user_id)"""

ORACLES["row_cap"] = f"""WITH {EV}
SELECT event_id, user_id FROM ev ORDER BY {unit_hash('event_id')}, event_id LIMIT 3000"""

ORACLES["holdout_flag"] = f"""WITH {EV}
SELECT event_id, {unit_hash('user_id')} < 0.2 AS held_out FROM ev"""
