"""DuckDB SQL oracles for ``city_queries``: the whole ETL of each city in SQL."""

from __future__ import annotations

from .context_oracles import GTFS, HOLI
from .event_oracles import EV, hav

ORACLES: dict[str, str] = {}


def _lags(order: str) -> str:
    """v -> b: visits with speed lags and their place in (split, ent)."""
    return f"""l AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS _dist,
             t_us / 1e6 - lag(t_us / 1e6) OVER w AS _dt FROM v WINDOW w AS (PARTITION BY split, ent ORDER BY {order})),
s AS (SELECT *, CASE WHEN _dt <> 0 THEN _dist / _dt END AS _vel FROM l),
b AS (SELECT *, coalesce(lag(_vel, 1) OVER w, 0) AS vel_lag_1, coalesce(lag(_vel, 2) OVER w, 0) AS vel_lag_2,
             coalesce(lag(_vel, 3) OVER w, 0) AS vel_lag_3, row_number() OVER w - 1 AS rn
      FROM s WINDOW w AS (PARTITION BY split, ent ORDER BY {order}))"""


def _pairs(train: str, max_tt: float, keys: str, dest: str = "", in_order: str = "d.seq > o.seq") -> str:
    """b -> f: pairs of both splits with the expanding mean, the train state carried to test.

    ``dest`` is the prefix of the destination's columns (leg rows end elsewhere)."""
    d = f"d.{dest}"
    return f"""pr AS (SELECT o.split, o.ent, o.route_id, o.direction_id, o.stop_id AS o_stop, {d}stop_id AS d_stop,
             d.rn - o.rn AS k, d.seq - o.seq AS gap, o.t_us AS t_o_us, o.seq AS seq_o, {d}t_us - o.t_us AS tt_us,
             {hav('o.lat', 'o.lon', f'{d}lat', f'{d}lon')} AS dist, o.vel_lag_1, o.vel_lag_2, o.vel_lag_3,
             o.lat AS o_lat, o.lon AS o_lon, {d}lat AS d_lat, {d}lon AS d_lon
      FROM b o JOIN b d ON o.split = d.split AND o.ent = d.ent AND d.rn > o.rn
      WHERE {in_order} AND {d}t_us > o.t_us AND ({d}t_us - o.t_us) / 1e6 <= {max_tt} AND (o.split = 'test' OR {train})),
pd AS (SELECT * FROM pr WHERE dist IS NOT NULL),
carried AS (SELECT {keys}, sum(tt_us) AS s0, count(*) AS n0 FROM pd WHERE split = 'train' GROUP BY ALL),
y AS (SELECT pd.*, coalesce(sum(tt_us) OVER w, 0) AS s, count(tt_us) OVER w AS cnt FROM pd
      WINDOW w AS (PARTITION BY split, {keys} ORDER BY k, t_o_us, seq_o, d_stop, ent, tt_us
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT y.*, CASE WHEN split = 'test' THEN coalesce(s0, 0) ELSE 0 END AS s0x,
             CASE WHEN split = 'test' THEN coalesce(n0, 0) ELSE 0 END AS n0x FROM y LEFT JOIN carried USING ({keys})),
f AS (SELECT *, CASE WHEN n0x + cnt = 0 THEN dist / 5.0 ELSE CAST(s0x + s AS DOUBLE) / (n0x + cnt) / 1e6 END AS hist FROM z)"""


WEATHER = """w AS (SELECT date_trunc('hour', ts) AS hour_key, max(value) AS temperature_2m,
             CAST(count(*) AS DOUBLE) / 10 AS precipitation FROM ev GROUP BY 1)"""


def _calendar_row(tz: str | None, hops: str = "k", holidays: str = "()") -> str:
    lt = f"timezone('{tz}', timezone('UTC', make_timestamp(t_o_us)))" if tz else "make_timestamp(t_o_us)"
    holiday = f"CASE WHEN CAST({lt} AS DATE) IN {holidays} THEN 1 ELSE 0 END" if holidays != "()" else "0"
    return f"""SELECT CAST(tt_us / 1e6 AS FLOAT) AS tiempo_viaje_segundos, CAST(hour({lt}) AS TINYINT) AS hora_del_dia,
       CAST(isodow({lt}) - 1 AS TINYINT) AS dia_semana, CAST(month({lt}) AS TINYINT) AS mes,
       CAST(temperature_2m AS FLOAT) AS temperature_2m, CAST(coalesce(precipitation, 0) AS FLOAT) AS precipitation,
       CAST(0 AS FLOAT) AS snowfall, CAST({holiday} AS FLOAT) AS is_holiday,
       route_id, direction_id, o_stop AS stop_id_origen, d_stop AS stop_id_destino,
       CAST(dist AS FLOAT) AS distancia_proyectada, CAST(vel_lag_1 AS FLOAT) AS vel_lag_1,
       CAST(vel_lag_2 AS FLOAT) AS vel_lag_2, CAST(vel_lag_3 AS FLOAT) AS vel_lag_3,
       CAST({hops} AS FLOAT) AS num_paradas_salto, CAST(hist AS FLOAT) AS tiempo_promedio_historico,
       CAST(k AS INTEGER) AS k, split
FROM f LEFT JOIN w ON date_trunc('hour', make_timestamp(t_o_us)) = w.hour_key"""


ORACLES["od_features_toronto"] = f"""WITH {EV},
p AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS ent, CAST(route_id AS VARCHAR) AS route_id,
             CASE WHEN event_id % 11 <> 0 THEN stop_id END AS stop_id, lat, lon,
             CAST(1704067200 + floor((t_us / 1e6 - 1704067200) / 60) AS BIGINT) AS ts_s FROM ev),
ps AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts_s, id) <= floor(count(*) OVER () * 0.8)
                      THEN 'train' ELSE 'test' END AS split, ts_s * 100000000 + id AS at_key FROM p),
m AS (SELECT split, ent, ts_s // 60 * 60000000 AS t_us, arg_min(route_id, at_key) AS route_id,
             coalesce(arg_min(stop_id, at_key) FILTER (WHERE stop_id IS NOT NULL), 'SNAPPED_UNKNOWN') AS stop_id,
             arg_min(lat, at_key) AS lat, arg_min(lon, at_key) AS lon FROM ps GROUP BY ALL),
v AS (SELECT split, ent, route_id, '0' AS direction_id, stop_id, t_us AS seq, t_us,
             CAST(CAST(lat AS FLOAT) AS DOUBLE) AS lat, CAST(CAST(lon AS FLOAT) AS DOUBLE) AS lon FROM m),
{_lags('t_us')},
{_pairs('d.rn - o.rn <= 10', 7200.0, 'route_id, o_stop, d_stop')},
{WEATHER}
{_calendar_row('America/Toronto', holidays=HOLI)}"""

STOPS = """sp AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id,
             CASE WHEN s_suppkey % 23 <> 0 THEN CAST('41.' || lpad(CAST(s_suppkey * 37 % 9973 AS VARCHAR), 4, '0') AS FLOAT) END AS lat,
             CAST('28.' || lpad(CAST(s_suppkey * 53 % 9967 AS VARCHAR), 4, '0') AS FLOAT) AS lon FROM supplier)"""

ORACLES["od_features_boston"] = f"""WITH {EV}, {STOPS},
a AS (SELECT CAST(l_orderkey AS VARCHAR) AS ent, CAST(l_orderkey % 7 AS VARCHAR) AS route_id,
             CAST(l_orderkey % 2 AS VARCHAR) AS direction_id, CAST(l_suppkey AS VARCHAR) AS stop_id, l_linenumber * 3 AS seq,
             epoch_us(timezone('America/New_York', CAST(DATE '2023-12-01' + CAST(l_orderkey % 50 AS INTEGER) AS TIMESTAMP)))
             + ((5 + l_linenumber) * 3600 + (l_partkey % 60) * 60) * 1000000 AS t_us
      FROM lineitem WHERE l_partkey % 13 <> 0),
v AS (SELECT a.*, CASE WHEN year(make_timestamp(t_us)) = 2023 THEN 'train' ELSE 'test' END AS split,
             CAST(sp.lat AS DOUBLE) AS lat, CAST(sp.lon AS DOUBLE) AS lon FROM a LEFT JOIN sp USING (stop_id)),
{_lags('seq, t_us, stop_id')},
{_pairs('(d.rn - o.rn <= 10 AND d.seq - o.seq <= 10)', 7200.0, 'route_id, o_stop, d_stop')},
{WEATHER}
{_calendar_row('America/New_York', hops='gap', holidays=HOLI)}"""

ORACLES["od_features_istanbul"] = f"""WITH {EV}, {STOPS},
g AS (SELECT CAST(l_orderkey AS VARCHAR) AS ent, l_linenumber AS seq, CAST(l_suppkey AS VARCHAR) AS stop_id,
             CASE WHEN l_partkey % 7 <> 0 THEN CAST((20 + l_linenumber) * 3600 + (l_partkey % 60) * 60 AS DOUBLE) END AS sec,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR),
                                sec NULLS LAST) AS rn0 FROM lineitem),
n AS (SELECT *,
  last_value(sec IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN sec IS NOT NULL THEN rn0 END IGNORE NULLS) OVER a AS pr,
  first_value(sec IGNORE NULLS) OVER z AS nv, first_value(CASE WHEN sec IS NOT NULL THEN rn0 END IGNORE NULLS) OVER z AS nr
  FROM g WINDOW a AS (PARTITION BY ent ORDER BY rn0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                z AS (PARTITION BY ent ORDER BY rn0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT ent, seq, stop_id, CAST(round(coalesce(sec, CASE WHEN nv IS NULL THEN pv
             ELSE pv + (nv - pv) * ((rn0 - pr) / (nr - pr)) END) * 1e6) AS BIGINT) AS t_us FROM n),
tp AS (SELECT CAST(o_orderkey AS VARCHAR) AS ent, o_orderpriority AS route_id,
              CASE WHEN o_orderstatus <> 'P' THEN '1' ELSE '0' END AS direction_id
       FROM orders JOIN customer ON o_custkey = c_custkey),
u AS (SELECT i.*, CAST(sp.lat AS DOUBLE) AS lat, CAST(sp.lon AS DOUBLE) AS lon, tp.route_id,
             coalesce(tp.direction_id, '0') AS direction_id
      FROM i JOIN sp USING (stop_id) LEFT JOIN tp USING (ent) WHERE t_us IS NOT NULL AND sp.lat IS NOT NULL),
tr AS (SELECT ent, min(t_us) AS start FROM u GROUP BY ent),
lab AS (SELECT ent, CASE WHEN row_number() OVER (ORDER BY start, ent) <= floor(count(*) OVER () * 0.8)
                         THEN 'train' ELSE 'test' END AS split FROM tr),
v AS (SELECT u.*, lab.split FROM u JOIN lab USING (ent)),
{_lags('seq, t_us, stop_id')},
{_pairs('d.rn - o.rn <= 15', 7200.0, 'o_stop, d_stop')},
w AS (SELECT hour(ts) AS h, max(value) AS temperature_2m, CAST(count(*) AS DOUBLE) / 10 AS precipitation
      FROM ev WHERE hour(ts) <> 23 GROUP BY 1)
SELECT CAST(tt_us / 1e6 AS FLOAT) AS travel_time_seconds, CAST(t_o_us // 3600000000 % 24 AS TINYINT) AS hora_del_dia,
       CAST(coalesce(temperature_2m, 0) AS FLOAT) AS temperature_2m, CAST(coalesce(precipitation, 0) AS FLOAT) AS precipitation,
       o_stop AS stop_id, route_id, direction_id, d_stop AS dest_stop_id, CAST(o_lat AS FLOAT) AS stop_lat,
       CAST(o_lon AS FLOAT) AS stop_lon, CAST(d_lat AS FLOAT) AS dest_lat, CAST(d_lon AS FLOAT) AS dest_lon,
       CAST(t_o_us / 1e6 AS FLOAT) AS arrival_seconds, CAST(dist AS FLOAT) AS distancia_proyectada,
       CAST(dist / (tt_us / 1e6) AS FLOAT) AS velocidad_tramo_m_s, CAST(vel_lag_1 AS FLOAT) AS vel_lag_1,
       CAST(vel_lag_2 AS FLOAT) AS vel_lag_2, CAST(vel_lag_3 AS FLOAT) AS vel_lag_3, CAST(k AS TINYINT) AS num_paradas_salto,
       CAST(hist AS FLOAT) AS tiempo_promedio_historico, CAST(k AS INTEGER) AS k, split
FROM f LEFT JOIN w ON t_o_us // 3600000000 % 24 = w.h"""

FILLED_WEATHER = """w0 AS (SELECT date_trunc('hour', ts) AS hour_key, CASE WHEN hour(any_value(ts)) % 4 <> 0 THEN max(value) END AS temperature_2m,
              CAST(count(*) AS DOUBLE) / 10 AS precipitation FROM ev WHERE hour(ts) <> 22 GROUP BY 1),
hs AS (SELECT split, min(date_trunc('hour', make_timestamp(t_o_us))) AS a, max(date_trunc('hour', make_timestamp(t_o_us))) AS b
       FROM f GROUP BY split),
hr AS (SELECT split, unnest(generate_series(least(a, (SELECT min(hour_key) FROM w0)),
                                            greatest(b, (SELECT max(hour_key) FROM w0)), INTERVAL 1 HOUR)) AS hour_key FROM hs),
w1 AS (SELECT hr.split AS ws, hr.hour_key, w0.temperature_2m AS t0, w0.precipitation FROM hr LEFT JOIN w0 USING (hour_key)),
w AS (SELECT ws, hour_key, precipitation, coalesce(t0,
        last_value(t0 IGNORE NULLS) OVER (PARTITION BY ws ORDER BY hour_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(t0 IGNORE NULLS) OVER (PARTITION BY ws ORDER BY hour_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        AS temperature_2m FROM w1)"""

ORACLES["od_features_izmir"] = f"""WITH {EV}, {GTFS},
pos AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, CASE WHEN s_suppkey % 23 <> 0 THEN 40 + s_acctbal / 10000 END AS lat,
               -3 - s_nationkey / 100.0 AS lon FROM supplier),
tp AS (SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, o_orderpriority AS route_id,
              CASE WHEN o_orderstatus <> 'P' THEN '1' ELSE '0' END AS direction_id FROM orders),
u AS (SELECT t.trip_id || '_' || strftime(a.d, '%Y%m%d') AS ent, st.trip_id, st.seq AS line, st.stop_id,
             epoch_us(CAST(a.d AS TIMESTAMP)) + (st.arr_s + 30) * 1000000 AS t_us,
             epoch_us(CAST(a.d AS TIMESTAMP)) + st.arr_s * 1000000 AS arr_us
      FROM active a JOIN trips t ON t.service_id = a.service_id JOIN st ON st.trip_id = t.trip_id),
x AS (SELECT ent, trip_id, stop_id, t_us, lead(stop_id) OVER w AS d_stop_id, lead(arr_us) OVER w AS d_t_us
      FROM u WINDOW w AS (PARTITION BY ent ORDER BY line, t_us, stop_id)),
g AS (SELECT x.*, o.lat, o.lon, d.lat AS d_lat, d.lon AS d_lon,
             CAST(CAST({hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS FLOAT) AS DOUBLE) / ((d_t_us - t_us) / 1e6) AS speed
      FROM x JOIN pos o ON o.stop_id = x.stop_id JOIN pos d ON d.stop_id = x.d_stop_id
      WHERE d_t_us > t_us AND o.lat IS NOT NULL AND d.lat IS NOT NULL),
gl AS (SELECT *, coalesce(CAST(lag(speed, 1) OVER w AS FLOAT), 0) AS vel_lag_1,
              coalesce(CAST(lag(speed, 2) OVER w AS FLOAT), 0) AS vel_lag_2,
              coalesce(CAST(lag(speed, 3) OVER w AS FLOAT), 0) AS vel_lag_3
       FROM g WINDOW w AS (PARTITION BY ent ORDER BY t_us, d_t_us, stop_id, d_stop_id)),
v AS (SELECT gl.*, t_us AS seq, tp.route_id, tp.direction_id,
             CASE WHEN row_number() OVER (ORDER BY t_us, ent, d_stop_id, stop_id) <= floor(count(*) OVER () * 0.8)
                  THEN 'train' ELSE 'test' END AS split
      FROM gl JOIN tp USING (trip_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY split, ent ORDER BY seq, d_stop_id, stop_id) - 1 AS rn FROM v),
{_pairs('d.rn - o.rn <= 15', 9000.0, 'route_id, direction_id, o_stop, d_stop', 'd_', 'TRUE')},
{FILLED_WEATHER}
{_calendar_row(None)} AND w.ws = f.split"""

ORACLES["od_features_konya"] = f"""WITH {EV}, {STOPS},
tk AS (SELECT *, CAST(1704067200 + floor((t_us / 1e6 - 1704067200) / 60) AS BIGINT) AS s FROM ev),
nx AS (SELECT user_id, event_id, s, lead(s) OVER w AS s2, lead(event_id) OVER w AS e2 FROM tk
       WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
lg AS (SELECT CAST(user_id AS VARCHAR) AS vehicle, CAST(user_id % 7 AS VARCHAR) AS route, CAST(event_id % 97 + 1 AS VARCHAR) AS o,
              CAST(e2 % 97 + 1 AS VARCHAR) AS d, event_id, s AS dep,
              CASE WHEN event_id % 4 = 1 THEN s + (s2 - s) * 3 // 5 ELSE s2 END AS arr
       FROM nx WHERE e2 IS NOT NULL AND event_id % 29 <> 0 AND event_id % 31 <> 0),
rw AS (SELECT vehicle, route, o, d, dep, CASE WHEN event_id % 3 = 0 THEN dep + (arr - dep) // 2 ELSE arr END AS arr FROM lg
       UNION ALL SELECT vehicle, route, o, d, dep + (arr - dep) // 2, arr FROM lg WHERE event_id % 3 = 0),
fl AS (SELECT *, CASE WHEN lag(o) OVER w IS NULL OR route <> lag(route) OVER w OR o <> lag(o) OVER w OR d <> lag(d) OVER w
                      THEN 1 ELSE 0 END AS flag FROM rw WINDOW w AS (PARTITION BY vehicle ORDER BY dep, arr, o)),
il AS (SELECT *, sum(flag) OVER (PARTITION BY vehicle ORDER BY dep, arr, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 AS island FROM fl),
cl AS (SELECT vehicle, island, min(dep) AS dep, max(arr) AS arr, min(route) AS route, min(o) AS o, min(d) AS d
       FROM il GROUP BY vehicle, island HAVING max(arr) - min(dep) >= 30),
st AS (SELECT cl.*, a.lat, a.lon, e.lat AS d_lat, e.lon AS d_lon, {hav('a.lat', 'a.lon', 'e.lat', 'e.lon')} AS dist0
       FROM cl JOIN (SELECT stop_id, CAST(CAST(lat AS VARCHAR) AS DOUBLE) AS lat, CAST(CAST(lon AS VARCHAR) AS DOUBLE) AS lon FROM sp) a ON a.stop_id = o
       JOIN (SELECT stop_id, CAST(CAST(lat AS VARCHAR) AS DOUBLE) AS lat, CAST(CAST(lon AS VARCHAR) AS DOUBLE) AS lon FROM sp) e ON e.stop_id = d
       WHERE a.lat IS NOT NULL AND e.lat IS NOT NULL),
sl AS (SELECT *, coalesce(lag(dist0 / (arr - dep), 1) OVER w, 0) AS vel_lag_1, coalesce(lag(dist0 / (arr - dep), 2) OVER w, 0) AS vel_lag_2,
              coalesce(lag(dist0 / (arr - dep), 3) OVER w, 0) AS vel_lag_3,
              CASE WHEN lag(dep) OVER w IS NULL OR route <> lag(route) OVER w OR dep - lag(arr) OVER w > 900 OR o <> lag(d) OVER w
                   THEN 1 ELSE 0 END AS flag FROM st WINDOW w AS (PARTITION BY vehicle ORDER BY dep, arr, o)),
tr AS (SELECT *, vehicle || '_' || sum(flag) OVER (PARTITION BY vehicle ORDER BY dep, arr, o
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ent FROM sl),
v AS (SELECT ent, route AS route_id, '0' AS direction_id, o AS stop_id, dep * 1000000 AS seq, dep * 1000000 AS t_us, lat, lon,
             d AS d_stop_id, arr * 1000000 AS d_t_us, d_lat, d_lon, vel_lag_1, vel_lag_2, vel_lag_3,
             CASE WHEN row_number() OVER (ORDER BY dep, ent, d, o) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
      FROM tr),
b AS (SELECT *, row_number() OVER (PARTITION BY split, ent ORDER BY seq, d_stop_id, stop_id) - 1 AS rn FROM v),
{_pairs('d.rn - o.rn <= 15', 9000.0, 'route_id, o_stop, d_stop', 'd_', 'TRUE')},
{FILLED_WEATHER}
{_calendar_row(None)} AND w.ws = f.split"""
