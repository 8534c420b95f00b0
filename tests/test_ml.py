import os
import tempfile

import pytest
from pyspark.sql import functions as F

from headway.ml import models
from headway.ml.chained import predict_chained


@pytest.fixture(scope="module")
def train(spark):
    df = spark.range(0, 400).select(
        F.col("id"), (F.col("id") % 7).cast("string").alias("route_id"),
        (F.col("id") % 13).cast("string").alias("stop"), (F.col("id") % 10 + 1).cast("double").alias("hops"),
        (F.col("id") % 50).cast("double").alias("hist"))
    return df.withColumn("tt", F.col("hops") * 30 + F.col("hist") * 0.5 + F.col("route_id").cast("double"))


def test_fit_save_load_importance(spark, train):
    pipe = models.regressor_pipeline(["hops", "hist"], ["route_id", "stop"], "tt",
                                     dict(models.ETA_PARAMS, maxIter=5, maxDepth=4), high_cardinality=("stop",))
    model, hold = models.fit_with_holdout(train, pipe, ["id"], "tt")
    assert hold.first()["n"] > 0
    path = tempfile.mkdtemp(prefix="model-") + "/m"
    models.save_model(model, path)
    again = models.load_model(path)
    a = [r["prediction"] for r in model.transform(train).orderBy("id").limit(5).collect()]
    b = [r["prediction"] for r in again.transform(train).orderBy("id").limit(5).collect()]
    assert a == b
    imp = models.feature_importance(spark, again).collect()
    assert imp[0]["rank"] == 1 and {r["feature"] for r in imp} >= {"hops", "hist"}
    with pytest.raises(FileNotFoundError):
        models.load_model(os.path.join(tempfile.mkdtemp(), "missing"))


def test_chained_equals_direct_within_horizon(spark, train):
    def model(df):
        return df.withColumn("prediction", F.col("num_paradas_salto") * 2 + F.col("tiempo_promedio_historico"))
    feats = train.select("id", F.col("hops").cast("int").alias("k"), F.col("hops").alias("num_paradas_salto"),
                         F.col("hist").alias("tiempo_promedio_historico"))
    out = {r["id"]: (r["n_segments"], r["prediction"]) for r in predict_chained(model, feats, "id", 4).collect()}
    for r in feats.collect():
        k, hist = r["k"], r["tiempo_promedio_historico"]
        if k <= 4:
            assert out[r["id"]] == (1, k * 2 + hist)
        else:
            m = -(-k // 4)
            assert out[r["id"]][0] == m
            assert abs(out[r["id"]][1] - (2 * k + hist)) < 1e-9   # linear model: segments add up


def test_random_search_maps_are_seeded(spark, train):
    pipe = models.regressor_pipeline(["hops", "hist"], ["route_id"], "tt", dict(models.CROWD_PARAMS, maxIter=3))
    a = models.random_search(train, pipe, "tt", trials=3, seed=1)
    b = models.random_search(train, pipe, "tt", trials=3, seed=1)
    assert [sorted((p.name, v) for p, v in m.items()) for m in a.getEstimatorParamMaps()] == \
           [sorted((p.name, v) for p, v in m.items()) for m in b.getEstimatorParamMaps()]
    fitted = models.random_search(train, pipe, "tt", trials=2, seed=1, parallelism=2).fit(train)
    assert len(fitted.validationMetrics) == 2


def test_training_rows_keep_all_cores_busy(spark, train):
    """A training table from one partition is dealt over the cores, whole, in an order that does not depend on the run."""
    one = train.withColumn("unused", F.lit(1)).coalesce(1)
    a = models.training_table(one, ["id"], ["route_id", "tt"])
    assert a.columns == ["id", "route_id", "tt"]
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, one.select(*a.columns).collect()))
    files = {r["f"]: r["n"] for r in a.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(files) >= spark.sparkContext.defaultParallelism and max(files.values()) < 200
    b = models.training_table(train.repartition(3), ["id"], ["route_id", "tt"])
    place = lambda d: {r["id"]: r["p"] for r in d.select("id", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("p")).collect()}
    assert place(a) == place(b)
