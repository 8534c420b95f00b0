"""Driver queries for saved models, evaluation reports and landed weather files.

The model is a saved and reloaded ``PipelineModel`` with a closed form, so SQL can repeat every row.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import models
from ..ml.chained import predict_chained
from ..operators import enrich, metrics
from ..session import scratch_path
from ..sources import readers
from .context_queries import K_MODEL_EVENTS, _hourly_weather, _scored_pairs
from .events_model import r4, read_table, stop_events

LINE_FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "ship_month"]
WEATHER = ["temperature_2m", "precipitation", "snowfall"]


def saved_model(spark: SparkSession) -> PipelineModel:
    """30 s per square root of the hops plus 0.9 of the historical time, saved and loaded again (K6)."""
    path = scratch_path(spark, "closed-form-model")
    formula = "30.0D * sqrt(num_paradas_salto) + 0.9D * tiempo_promedio_historico"
    models.save_model(PipelineModel([SQLTransformer(statement=f"SELECT *, {formula} AS prediction FROM __THIS__")]), path)
    return models.load_model(path)


def _features(pairs: DataFrame) -> DataFrame:
    return pairs.select("o_event_id", "d_event_id", "k", "tt", F.col("k").cast("double").alias("num_paradas_salto"),
                        F.col("hist_avg").alias("tiempo_promedio_historico"))


def q_batch_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M5 + K6 + A16: every bounded pair scored by a loaded model, with the rows that a timed run counts."""
    scored = models.score(saved_model(spark), _features(_scored_pairs(spark, sf)))
    rows = metrics.timed_run(scored, "batch_scores")["rows"]
    return scored.select("o_event_id", "d_event_id", r4("prediction").alias("prediction"), F.lit(rows).cast("long").alias("rows_scored"))


def q_out_of_time_report(spark: SparkSession, sf: str) -> DataFrame:
    """M11 + M6 + A7: per horizon and overall, beyond the model's horizon by chained segments."""
    # k is no feature of an id: the label goes with the row's key through the chain
    scored = predict_chained(saved_model(spark).transform, _features(_scored_pairs(spark, sf, True)),
                             ["o_event_id", "d_event_id", "tt"], K_MODEL_EVENTS)
    m = models.out_of_time_report(scored, "tt", "k", K_MODEL_EVENTS)
    return m.select(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), r4("mae").alias("mae"),
                    r4("rmse").alias("rmse"), r4("r2").alias("r2"), r4("share").alias("share"), "mode")


def q_crowd_report(spark: SparkSession, sf: str) -> DataFrame:
    """A11 + J4: the load of every arrival (``l_quantity``) against its context's mean of the year before."""
    li = read_table(spark, sf, "lineitem").withColumn("yr", F.year("l_shipdate"))
    context = ["l_returnflag", "l_linestatus", "yr"]
    base = (li.groupBy(*context).agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("baseline_qty"))
              .withColumn("yr", F.col("yr") + 1))
    m = metrics.crowd_report(enrich.attach_baseline(li, base, context, "baseline_qty"), "l_quantity", "baseline_qty")
    return m.select(F.col("n").cast("long").alias("n"), *[r4(c).alias(c) for c in
                                                          ("mae", "rmse", "r2", "mean_y", "rmse_pct_of_mean")])


def q_feature_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """W12 + T11 + T12: arrival features ranked by the absolute correlation with the load, the first five."""
    li = read_table(spark, sf, "lineitem").withColumn("ship_month", F.month("l_shipdate"))
    ranked = metrics.feature_ranking(metrics.correlation_importance(li, LINE_FEATURES, "l_quantity"), 5)
    return ranked.select("feature", r4("importance").alias("importance"), F.col("rank").cast("long").alias("rank"))


def land_weather(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Hourly weather as JSON files of a day each (parallel arrays), and as a start, an interval and
    24 values a day (null where an hour has none). A day has at most 24 hours."""
    w = _hourly_weather(stop_events(spark, sf)).withColumn("snowfall", F.lit(0.5) * F.hour("hour_key"))
    day = F.date_trunc("day", F.col("hour_key"))
    hours = w.groupBy(day.alias("day")).agg(F.array_sort(F.collect_list(F.struct("hour_key", *WEATHER))).alias("h"))
    times = F.transform("h", lambda x: F.date_format(x["hour_key"], "yyyy-MM-dd'T'HH:mm"))
    doc = F.struct(F.struct(times.alias("time"), *[F.col(f"h.{c}").alias(c) for c in WEATHER]).alias("hourly"))
    path = scratch_path(spark, "weather-json")
    hours.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    at = F.map_from_arrays(F.transform("h", lambda x: F.hour(x["hour_key"])), F.col("h.temperature_2m"))
    grid = hours.select(F.unix_seconds("day").alias("start"), F.lit(3600).alias("interval_s"),
                        F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.try_element_at(at, i)).alias("temperature_2m"))
    return path, grid


def q_weather_files(spark: SparkSession, sf: str) -> DataFrame:
    """S8 + S9: every hour of the days with weather, from the files of values and from the files of arrays."""
    path, grid = land_weather(spark, sf)
    files = readers.weather_from_json(spark.read.text(path), "value")
    arrays = readers.weather_from_arrays(grid).withColumnRenamed("temperature_2m", "temperature_grid")
    d = arrays.join(files, "hour_key", "full")
    return d.select(F.date_format("hour_key", "yyyy-MM-dd HH:mm").alias("hour"), *[r4(c).alias(c) for c in
                                                                                [*WEATHER, "temperature_grid"]])


QUERIES = {
    "batch_scores": q_batch_scores,
    "out_of_time_report": q_out_of_time_report,
    "crowd_report": q_crowd_report,
    "feature_ranking": q_feature_ranking,
    "weather_files": q_weather_files,
}
