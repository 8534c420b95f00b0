"""Role mapping of the driver's ``events`` table onto the transit data model.

entity = ``user_id`` (a vehicle / trip), time = ``ts``, stop = ``event_type``,
route = ``user_id % 7``, coordinates derived from ``event_id``. Every query built on
this reads the whole table; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed parameters of the event mapping (shared with the SQL oracles).
K_EVENTS = 10                    # lookahead horizon for bounded pairs
MAX_TT_EVENTS_S = 2 * 86400.0    # events are sparse (~67 per user per month): days, not 7200 s
ORDER = ["t_us", "event_id"]     # time, then a unique tie-break
SPLIT_CUTOFF = "2024-01-21"      # date split of the event month
TRAIN_FRACTION = 0.8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # naive timestamps are read as UTC wall time (as the SQL oracle does): pin the zone
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (event_id, user_id, route_id, stop_id, t_us, t, lat, lon, value, ts, props)."""
    ev = read_table(spark, sf_dir, "events")
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(
        "event_id", "user_id", "event_type", "value", "props", "ts",
        (F.col("user_id") % 7).alias("route_id"),
        F.col("event_type").alias("stop_id"),
        (F.lit(41) + (F.col("event_id") % 997) / 10000.0).alias("lat"),
        (F.lit(28.9) + (F.col("event_id") % 991) / 10000.0).alias("lon"),
        t_us.alias("t_us"),
        (t_us / 1e6).alias("t"),
    )


def r4(c):
    """Round a float output to 4 decimals as ``floor(x*1e4 + 0.5) / 1e4``.

    The oracle uses the same IEEE expression, so both sides produce identical doubles
    (``round`` differs: Spark rounds the decimal string, DuckDB the binary value)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x * 10000.0 + 0.5) / 10000.0
