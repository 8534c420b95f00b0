import inspect

import pytest
from pyspark.sql import functions as F

from headway.ml import models, search
from headway.operators import splits
from headway.plans import model_queries


@pytest.fixture(scope="module")
def trips(spark):
    d = spark.range(0, 1200).select("id", (F.col("id") % 4 + 1).cast("int").alias("k"),
                                    (F.col("id") % 10 + 1).cast("double").alias("hops"), (F.col("id") % 50).cast("double").alias("hist"))
    return d.withColumn("tt", F.col("hops") * 30 + F.col("hist") * 0.5).unionByName(
        d.limit(3).withColumn("tt", F.lit(None).cast("double")))


def search_twice(trips, **kw):
    pipe = models.regressor_pipeline(["hops", "hist"], [], "tt", models.ETA_PARAMS)
    run = lambda d: search.halving_search(d, pipe, "tt", "id", trials=5, fractions=(0.2, 0.4, 0.8), rounds=3, **kw)
    return run(trips).collect(), run(trips.repartition(7, "hist")).collect()


def test_worse_half_goes_and_rows_repeat(trips):
    a, b = search_twice(trips, seed=3)
    assert a == b                                       # also from other partitions of the input
    assert sorted(r["round"] for r in a) == [1, 1, 2, 3, 3]          # 5, then 3, then 2 settings
    assert sorted(r["rank"] for r in a) == [1, 2, 3, 4, 5]
    by_rank = sorted(a, key=lambda r: r["rank"])
    assert [r["round"] for r in by_rank] == [3, 3, 2, 1, 1] and by_rank[0]["rmse"] <= by_rank[1]["rmse"]
    assert {r["round"]: r["fraction"] for r in a} == {1: 0.2, 2: 0.4, 3: 0.8}
    lo, hi = models.SEARCH_SPACE["stepSize"]
    assert all(lo <= r["step_size"] <= hi for r in a)


def test_rounds_are_nested_and_hold_out_the_same_rows(trips):
    small, large = (search._sample(trips, ["id"], "k", f, 20.0, 42) for f in (0.2, 0.4))
    s, g = ({r["id"]: r["_held"] for r in d.collect()} for d in (small, large))
    assert s.items() <= g.items() and len(s) < len(g)
    assert 0.1 < sum(s.values()) / len(s) < 0.3         # not the sample's own lowest hashes
    flags = trips.select("id", splits.holdout_flag(["id"], 20.0, 43).alias("h")).distinct().collect()
    assert all(r["h"] == g[r["id"]] for r in flags if r["id"] in g)


def test_too_small_a_sample_is_refused(trips):
    pipe = models.regressor_pipeline(["hops", "hist"], [], "tt", models.ETA_PARAMS)
    with pytest.raises(ValueError, match="larger fraction"):
        search.halving_search(trips.limit(0), pipe, "tt", "id", trials=2, fractions=(0.1,))


def test_query_searches_all_settings_on_all_rows(spark, trips, monkeypatch):
    asked = {}
    monkeypatch.setattr(model_queries, "_train_features", lambda spark, sf: (trips, None))
    monkeypatch.setattr(model_queries, "halving_search", lambda *a, **kw: asked.update(
        inspect.signature(search.halving_search).bind(*a, **kw).arguments))
    model_queries.q_search_halving(spark, "")
    assert asked.get("trials", models.SEARCH_TRIALS) == 30 and asked.get("rounds", models.SEARCH_ROUNDS) == 300
    assert asked["train"] is trips and asked["fractions"][-1] == 1.0 and list(asked["fractions"]) == sorted(asked["fractions"])


def test_the_last_round_can_take_every_row(trips):
    """Also rows of null keys, which hash like any others."""
    d = trips.withColumn("id", F.when(F.col("id") % 5 != 0, F.col("id")))
    assert search._sample(d, ["id"], "k", 1.0, 20.0, 42).count() == d.count() == 1203
