"""DuckDB SQL oracles for ``report_queries`` (same names, same output columns)."""

from __future__ import annotations

from .context_oracles import SCORED_B, SCORED_U
from .event_oracles import EV, R4

ORACLES: dict[str, str] = {}

ORACLES["batch_scores"] = f"""WITH {SCORED_B}
SELECT o_event_id, d_event_id, {R4('30.0 * sqrt(CAST(k AS DOUBLE)) + 0.9 * hist_avg')} AS prediction,
       count(*) OVER () AS rows_scored FROM h"""

_SST = "(sum(tt * tt) - count(*) * pow(sum(tt) / count(*), 2))"
_REPORT = f"""count(*) AS n, {R4('sum(abs(yhat - tt)) / count(*)')} AS mae,
  {R4('sqrt(sum((yhat - tt) * (yhat - tt)) / count(*))')} AS rmse,
  {R4(f'CASE WHEN {_SST} > 0 THEN 1 - sum((yhat - tt) * (yhat - tt)) / {_SST} ELSE 0.0 END')} AS r2"""

ORACLES["out_of_time_report"] = f"""WITH {SCORED_U},
s AS (SELECT *, CASE WHEN k <= 3 THEN [CAST(k AS BIGINT)]
                     ELSE list_transform(range(m), lambda i: base + CASE WHEN i < rem THEN 1 ELSE 0 END) END AS segs
      FROM (SELECT *, (k + 2) // 3 AS m, k // ((k + 2) // 3) AS base, k % ((k + 2) // 3) AS rem FROM h)),
x AS (SELECT o_event_id, d_event_id, k, tt, hist_avg, unnest(segs) AS seg FROM s),
y AS (SELECT k, any_value(tt) AS tt, sum(30.0 * sqrt(CAST(seg AS DOUBLE))
        + 0.9 * CASE WHEN k <= 3 THEN hist_avg ELSE hist_avg * (CAST(seg AS DOUBLE) / k) END) AS yhat
      FROM x GROUP BY o_event_id, d_event_id, k),
m AS (SELECT CAST(k AS BIGINT) AS k, {_REPORT} FROM y GROUP BY k)
SELECT k, n, mae, rmse, r2, {R4('CAST(n AS DOUBLE) / sum(n) OVER ()')} AS share,
       CASE WHEN k <= 3 THEN 'direct' ELSE 'chained' END AS mode FROM m
UNION ALL SELECT NULL, {_REPORT}, CAST(1 AS DOUBLE), 'all' FROM y"""

_E = "(baseline_qty - l_quantity)"
_MEAN = "sum(l_quantity) / count(*)"
_RMSE = f"sqrt(sum({_E} * {_E}) / count(*))"
ORACLES["crowd_report"] = f"""WITH li AS (SELECT *, year(l_shipdate) AS yr FROM lineitem),
b AS (SELECT l_returnflag, l_linestatus, yr + 1 AS yr, sum(l_quantity) / count(*) AS baseline_qty
      FROM li GROUP BY l_returnflag, l_linestatus, yr),
x AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, coalesce(b.baseline_qty, 0.0) AS baseline_qty
      FROM li LEFT JOIN b USING (l_returnflag, l_linestatus, yr))
SELECT count(*) AS n, {R4(f'sum(abs({_E})) / count(*)')} AS mae, {R4(_RMSE)} AS rmse,
  {R4(f'1 - sum({_E} * {_E}) / (sum(l_quantity * l_quantity) - count(*) * pow({_MEAN}, 2))')} AS r2,
  {R4(_MEAN)} AS mean_y, {R4(f'{_RMSE} / ({_MEAN}) * 100.0')} AS rmse_pct_of_mean FROM x"""

_FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "ship_month"]
_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(abs(corr(l_quantity, {c})), 0.0) AS importance FROM x" for c in _FEATURES)
ORACLES["feature_ranking"] = f"""WITH x AS (SELECT *, month(l_shipdate) AS ship_month FROM lineitem),
c AS ({_CORR}),
r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM c)
SELECT feature, {R4('importance')} AS importance, rank FROM r WHERE rank <= 5"""

ORACLES["weather_files"] = f"""WITH {EV},
w AS (SELECT date_trunc('hour', ts) AS hour_key, max(value) AS temperature_2m,
             CAST(count(*) AS DOUBLE) / 10 AS precipitation, 0.5 * hour(date_trunc('hour', any_value(ts))) AS snowfall FROM ev GROUP BY 1),
grid AS (SELECT unnest(generate_series(d, d + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hour_key
         FROM (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 0 HOUR AS d FROM ev))
SELECT strftime(hour_key, '%Y-%m-%d %H:%M') AS hour, {R4('temperature_2m')} AS temperature_2m,
       {R4('precipitation')} AS precipitation, {R4('snowfall')} AS snowfall, {R4('temperature_2m')} AS temperature_grid
FROM grid LEFT JOIN w USING (hour_key)"""
