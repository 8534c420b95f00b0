"""Dataset registry (S14): per-city ETL parameters and model metadata as data.

Unknown names raise ``ValueError``. Paths are passed in by the caller; nothing here
reads the environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values shared by the feature ETLs and the evaluation.
MAX_LOOKAHEAD_STOPS = 15
OD_FEATURE_COLUMNS = [
    "tiempo_viaje_segundos", "hora_del_dia", "dia_semana", "mes", "temperature_2m", "precipitation",
    "snowfall", "is_holiday", "route_id", "direction_id", "stop_id_origen", "stop_id_destino",
    "distancia_proyectada", "vel_lag_1", "vel_lag_2", "vel_lag_3", "num_paradas_salto",
    "tiempo_promedio_historico",
]
# The 20 columns of the city whose clock is seconds of the service day.
CLOCK_FEATURE_COLUMNS = [
    "travel_time_seconds", "hora_del_dia", "temperature_2m", "precipitation", "stop_id", "route_id", "direction_id",
    "dest_stop_id", "stop_lat", "stop_lon", "dest_lat", "dest_lon", "arrival_seconds", "distancia_proyectada",
    "velocidad_tramo_m_s", "vel_lag_1", "vel_lag_2", "vel_lag_3", "num_paradas_salto", "tiempo_promedio_historico",
]
OD_NUMERIC = ["hora_del_dia", "dia_semana", "mes", "temperature_2m", "precipitation", "snowfall", "is_holiday",
              "distancia_proyectada", "vel_lag_1", "vel_lag_2", "vel_lag_3", "num_paradas_salto",
              "tiempo_promedio_historico"]


@dataclass(frozen=True)
class CityConfig:
    """Everything that differs between the city feature ETLs."""
    name: str
    target: str
    categorical: tuple[str, ...]
    entity: tuple[str, ...] = ()          # sequence key (trip, vehicle, rebuilt trip)
    order: tuple[str, ...] = ()           # order inside the entity (+ tie-breaks)
    k_train: int = 10                     # bounded lookahead for the train split
    max_tt_s: float = 7200.0              # F2 upper bound on travel time
    state_keys: tuple[str, ...] = ("route_id", "stop_id_origen", "stop_id_destino")
    order_gap_cap: bool = False           # train also requires order gap <= K (Boston)
    leg_input: bool = False               # rows are legs (Konya / Izmir off-by-one)
    tz: str | None = None                 # local zone for calendar features
    naive_as_utc: bool = False            # weather hour key relabels wall time (P9)
    temperature_fill: str = "null"        # null | zero | ffill
    split: str = "year"                   # year | rows | trips | date
    stage_order: tuple[str, ...] = field(default=("split", "lags", "pairs"))
    row: str = "calendar"                 # calendar (18 columns, P8) | clock (20 columns, P10, J6, P12)
    model_name: str = ""


# The registry of supported datasets.
CITIES: dict[str, CityConfig] = {
    "boston": CityConfig("boston", "tiempo_viaje_segundos",
                         ("route_id", "direction_id", "stop_id_origen", "stop_id_destino"),
                         ("half_trip_id",), ("seq", "t_us", "stop_id"), 10, 7200.0, order_gap_cap=True,
                         tz="America/New_York", split="year", stage_order=("split", "lags", "pairs"),
                         model_name="eta_boston"),
    "toronto": CityConfig("toronto", "tiempo_viaje_segundos",
                          ("route_id", "direction_id", "stop_id_origen", "stop_id_destino"),
                          ("vehicle_id",), ("t_us",), 10, 7200.0, tz="America/Toronto", split="rows",
                          stage_order=("split", "downsample", "lags", "pairs"), model_name="eta_toronto"),
    "istanbul": CityConfig("istanbul", "travel_time_seconds", ("stop_id", "route_id", "direction_id"),
                           ("trip_id",), ("seq", "t_us", "stop_id"), MAX_LOOKAHEAD_STOPS, 7200.0,
                           state_keys=("stop_id_origen", "stop_id_destino"), temperature_fill="zero", split="trips",
                           stage_order=("lags", "split", "pairs"), row="clock", model_name="eta_istanbul"),
    "konya": CityConfig("konya", "tiempo_viaje_segundos", ("route_id", "stop_id_origen", "stop_id_destino"),
                        ("trip_id",), ("seq", "dest_stop_id", "stop_id"), MAX_LOOKAHEAD_STOPS, 9000.0, leg_input=True,
                        naive_as_utc=True, temperature_fill="ffill", split="rows",
                        stage_order=("lags", "split", "pairs"), model_name="eta_konya"),
    "izmir": CityConfig("izmir", "tiempo_viaje_segundos",
                        ("route_id", "direction_id", "stop_id_origen", "stop_id_destino"),
                        ("trip_id",), ("seq", "dest_stop_id", "stop_id"), MAX_LOOKAHEAD_STOPS, 9000.0,
                        state_keys=("route_id", "direction_id", "stop_id_origen", "stop_id_destino"),
                        leg_input=True, naive_as_utc=True, temperature_fill="ffill", split="rows",
                        stage_order=("lags", "split", "pairs"), model_name="eta_izmir"),
    "sivas": CityConfig("sivas", "delay_min", ("line_id", "stop_id", "traffic_level", "weather_condition"),
                        split="date", model_name="eta_sivas"),
}


def city(name: str) -> CityConfig:
    key = name.lower()
    if key not in CITIES:
        raise ValueError(f"unsupported dataset: {name!r}; known: {sorted(CITIES)}")
    return CITIES[key]
