import json

from pyspark.sql import functions as F

from headway.operators import metrics
from headway.plans import report_queries

from .conftest import SF


def test_correlation_importance_of_flat_empty_and_null_columns(spark):
    d = spark.sql("SELECT id AS y, 2.0D * id AS same, -id AS other_way, 1 AS flat, CAST(NULL AS double) AS none FROM range(9)")
    cols = ["same", "other_way", "flat", "none"]
    got = {r["feature"]: r["importance"] for r in metrics.correlation_importance(d, cols, "y").collect()}
    assert abs(got["same"] - 1) < 1e-12 and abs(got["other_way"] - 1) < 1e-12 and got["flat"] == 0 and got["none"] == 0
    empty = metrics.correlation_importance(d.limit(0), cols, "y")
    assert [r["importance"] for r in empty.collect()] == [0.0] * 4
    ranked = metrics.feature_ranking(empty, 2).collect()
    assert [(r["feature"], r["rank"]) for r in ranked] == [("flat", 1), ("none", 2)]        # ties by name


def test_saved_model_is_loaded_and_scores(spark):
    d = spark.sql("SELECT 4.0D AS num_paradas_salto, 10.0D AS tiempo_promedio_historico")
    assert report_queries.saved_model(spark).transform(d).first()["prediction"] == 69.0


def test_weather_files_are_days_of_parallel_arrays(spark):
    path, grid = report_queries.land_weather(spark, SF)
    docs = [json.loads(r["value"])["hourly"] for r in spark.read.text(path).collect()]
    assert docs and all(len({len(v) for v in d.values()}) == 1 and len(d["time"]) <= 24 for d in docs)
    assert all(d["time"] == sorted(d["time"]) and len({t[:10] for t in d["time"]}) == 1 for d in docs)
    assert grid.where(F.size("temperature_2m") != 24).count() == 0 and grid.count() == len(docs)
