"""Point lookup of live ETAs for a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_float
from .live_eta import KEY, TTL_SECONDS


def lookup_eta(requests: DataFrame, live: DataFrame, now: Column, ttl_s: int = TTL_SECONDS) -> DataFrame:
    """Each request gets ``status`` = found / expired / not_found and the ETA fields
    (non-numeric or missing -> 0.0). A left join on the key, no per-request loop."""
    cols = ["eta_segundos", "nivel_confianza", "ultima_actualizacion"]
    j = requests.join(live.select(*KEY, *cols).withColumn("_hit", F.lit(True)), KEY, "left")
    fresh = F.col("ultima_actualizacion") > now - F.make_dt_interval(secs=F.lit(ttl_s))
    status = F.when(F.col("_hit").isNull(), "not_found").when(fresh, "found").otherwise("expired")
    return (j.withColumn("status", status)
             .withColumn("eta_segundos", F.when(F.col("status") == "found", safe_float("eta_segundos"))
                         .otherwise(F.lit(0.0)))
             .withColumn("nivel_confianza", F.when(F.col("status") == "found", safe_float("nivel_confianza"))
                         .otherwise(F.lit(0.0)))
             .drop("_hit"))
