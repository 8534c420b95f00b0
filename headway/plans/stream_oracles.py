"""DuckDB SQL oracles for ``stream_queries``."""

from __future__ import annotations

from .event_oracles import EV

ORACLES: dict[str, str] = {}

_POSITIONS = """SELECT CASE WHEN event_id % 17 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS vehicle_id,
       CAST(user_id % 7 AS VARCHAR) AS route_id, lat AS latitude, lon AS longitude,
       CAST(floor(t_us / 1e6) AS BIGINT) AS timestamp,
       CASE event_id % 5 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO'
                         WHEN 3 THEN 'STOPPED_AT' ELSE 'IN_TRANSIT_TO' END AS current_status
FROM ev WHERE event_id % 19 <> 0"""

ORACLES["ingest_positions"] = f"WITH {EV} {_POSITIONS}"

ORACLES["position_log_capped"] = f"""WITH {EV}, p AS ({_POSITIONS})
SELECT * FROM p ORDER BY timestamp DESC, vehicle_id LIMIT 2000"""

ORACLES["positions_deduplicated"] = f"""WITH {EV}, p AS ({_POSITIONS}) SELECT DISTINCT * FROM p"""

LIVE = f"""{EV},
w AS (SELECT date_trunc('hour', ts) AS hour_key, max(value) AS temperature_2m,
             CAST(count(*) AS DOUBLE) / 10 AS precipitation FROM ev GROUP BY 1),
cw AS (SELECT arg_max(temperature_2m, hour_key) AS temp, arg_max(precipitation, hour_key) AS prec FROM w),
se AS (SELECT event_id, CAST(user_id % 7 AS VARCHAR) AS route_id, '0' AS direction_id, event_type AS stop_id,
              'stop_' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS next_stop_id,
              ts, event_id % 4 = 0 AS has_off
       FROM ev WHERE event_id % 23 <> 0),
f AS (SELECT se.*, hour(ts) AS hora, isodow(ts) - 1 AS dia, month(ts) AS mes,
             CASE WHEN has_off THEN epoch_us(ts) - 10800000000
                  ELSE epoch_us(timezone('America/New_York', ts)) END AS inst, cw.temp, cw.prec
      FROM se, cw),
s AS (SELECT *, round(greatest(1.0, 40.0 + 5.0 * hora + 20.0 * prec), 1) AS eta FROM f),
c AS (SELECT *, CAST(round(greatest(0.10, least(0.99,
    0.75 - CASE WHEN hora BETWEEN 7 AND 9 OR hora BETWEEN 17 AND 19 THEN 0.12 ELSE 0 END
         + CASE WHEN eta < 60 THEN 0.10 WHEN eta > 900 THEN -0.10 ELSE 0 END
         - CASE WHEN dia >= 5 THEN 0.05 ELSE 0 END
         - CASE WHEN prec > 5 THEN 0.10 WHEN prec > 1 THEN 0.05 ELSE 0 END)), 2) AS DOUBLE) AS conf FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY route_id, stop_id, next_stop_id ORDER BY inst DESC, event_id DESC) AS rn
      FROM c),
live AS (SELECT * FROM r WHERE rn = 1)"""

ORACLES["eta_latest_stream"] = f"""WITH {LIVE}
SELECT route_id, stop_id, next_stop_id, direction_id, eta AS eta_segundos, conf AS nivel_confianza,
       CAST(hora AS BIGINT) AS hora_del_dia, CAST(dia AS BIGINT) AS dia_semana, CAST(mes AS BIGINT) AS mes,
       event_id, inst AS updated_us FROM live"""

ORACLES["eta_live_keys"] = f"""WITH {LIVE}
SELECT route_id, stop_id, next_stop_id, eta AS eta_segundos, inst AS updated_us FROM live
WHERE inst > (SELECT max(inst) FROM live) - 43200000000"""

ORACLES["eta_lookup"] = f"""WITH {LIVE},
nowv AS (SELECT max(inst) AS now FROM live),
req AS (SELECT event_id AS request_id, CAST(user_id % 7 AS VARCHAR) AS route_id, event_type AS stop_id,
               'stop_' || CAST((TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id) % 5 AS VARCHAR)
               AS next_stop_id FROM ev)
SELECT req.request_id,
       CASE WHEN live.route_id IS NULL THEN 'not_found' WHEN live.inst > nowv.now - 300000000 THEN 'found'
            ELSE 'expired' END AS status,
       CASE WHEN live.route_id IS NOT NULL AND live.inst > nowv.now - 300000000 THEN live.eta
            ELSE CAST(0 AS DOUBLE) END AS eta_segundos
FROM req LEFT JOIN live USING (route_id, stop_id, next_stop_id), nowv"""

ORACLES["scorer_totals"] = """SELECT count(*) AS received, count(*) FILTER (WHERE event_id % 23 <> 0
  AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL) AS accepted, count(*) - count(*) FILTER (
  WHERE event_id % 23 <> 0 AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL) AS rejected FROM events"""
