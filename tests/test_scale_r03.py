"""Findings of round 3 on growth: what is counted, ordered, shuffled or built, and how often."""
from pyspark.sql import functions as F

from headway.ml import search
from headway.operators import history, sequence, splits
from headway.plans import model_queries, schedule


def _gtfs(spark, trips):
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return {
        "calendar": spark.createDataFrame([("s", *["1"] * 7, "20240101", "20240131")],
                                          ["service_id", *days, "start_date", "end_date"]),
        "trips": spark.createDataFrame(trips, "route_id string, service_id string, trip_id string, direction_id string"),
        "stop_times": spark.createDataFrame(
            [(t, f"p{i}", str(i), f"0{i}:00:00", f"0{i}:00:30") for t in ("a", "b") for i in range(4)],
            "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string"),
        "stops": spark.createDataFrame([(f"p{i}", f"41.{i}", "29.0") for i in range(4)],
                                       "stop_id string, stop_lat string, stop_lon string")}


def test_legs_are_made_once_a_trip(spark):
    """the windows go over trips, not over trips times days."""
    legs = schedule.unroll_gtfs_legs(_gtfs(spark, [("r", "s", "a", "0"), ("r", "s", "b", None)]), days=3, n_lags=3)
    plan = legs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(trip_date_id" not in plan
    rows = legs.collect()
    assert len(rows) == 2 * 3 * 3 and len({r.trip_date_id for r in rows}) == 6
    assert {r.trip_date_id[-8:] for r in rows if r.cikis_zaman.strftime("%Y%m%d") == r.trip_date_id[-8:]} == {
        "20240101", "20240102", "20240103"}
    assert {r.tiempo_viaje_base for r in rows} == {3570.0}


def test_copies_of_a_trip_share_its_simulated_trip(spark):
    """A trip that is listed twice mixes the rows of its copies, as unrolling to days first does."""
    g = _gtfs(spark, [("r", "s", "a", "0"), ("r", "s", "a", "0"), ("r", "s", "b", "1")])
    legs = schedule.unroll_gtfs_legs(g, days=2, n_lags=3)
    got = {(r.trip_date_id, r.stop_id_origen, r.stop_id_destino): r["count"] for r in
           legs.groupBy("trip_date_id", "stop_id_origen", "stop_id_destino").count().collect()}
    assert got == {(f"{t}_2024010{d}", f"p{i}", f"p{i + 1}"): 1 for t in "ab" for d in (1, 2) for i in range(3)}


def test_only_the_rows_at_the_cut_are_ordered(spark, monkeypatch):
    """a split by share orders a few rows, whatever the outliers, ties and nulls."""
    monkeypatch.setattr(splits, "SPANS", 8)
    monkeypatch.setattr(splits, "EDGE_ROWS", 10)
    seen, number = [], splits.global_row_numbers
    monkeypatch.setattr(splits, "global_row_numbers", lambda d, o, *a: seen.append(d.count()) or number(d, o, *a))
    rows = [(i, None if i % 50 == 0 else 10**15 if i == 7 else -5 if i == 9 else i // 3 * 7) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t long")
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    for frac in (0.0, 0.1, 0.5, 0.8, 0.99, 1.0):
        got = {r.id for r in splits.split_fraction(df, ["t", "id"], frac).where("split = 'train'").collect()}
        assert got == {r[0] for r in order[:int(600 * frac)]}
    assert seen and max(seen) <= 12


def test_cold_entities_are_not_counted_one_by_one(spark, monkeypatch):
    """Entities are counted only in hash cells with enough rows for a hot one."""
    asked, count = [], sequence.hot_entities
    monkeypatch.setattr(sequence, "hot_entities", lambda d, *a: asked.append(d) or count(d, *a))
    df = spark.range(3000).select((F.col("id") % 1000).alias("u"), F.col("id"))
    assert sequence.route_entities(df, "u", 500) is None and not asked
    hot = sequence.route_entities(df.unionByName(spark.range(900).select(F.lit(None).cast("long").alias("u"), "id")), "u", 500)
    assert [r.u for r in hot.collect()] == [None] and asked[0].count() < 1000


def test_history_of_cold_keys_is_one_window(spark, monkeypatch):
    """Few pairs a key take one shuffle; hot keys give the same by blocks."""
    df = spark.range(400).select((F.col("id") % 9).alias("a"), (F.col("id") % 4 + 1).cast("int").alias("k"),
                                 (F.col("id") * 977 % 20000).cast("double").alias("t_o"), F.col("id"),
                                 (F.col("id") * 31 % 500).alias("tt")).withColumn("a", F.when(F.col("a") != 8, F.col("a")))
    state = spark.createDataFrame([(1, 1000, 3), (77, 5, 1)], "a long, sum_tt long, n long")
    mean = lambda: history.expanding_mean(df, ["a"], "tt", F.lit(1.0), "h", tiebreak=["id"], state=state)
    cold = mean()
    assert cold._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") + \
        cold._jdf.queryExecution().executedPlan().toString().count("Range (") == 2      # the pairs once, the state once
    monkeypatch.setattr(history, "KEY_ROWS", 10)
    row = lambda d: sorted((r.id, r.h) for r in d.collect())
    assert row(cold) == row(mean())


def test_search_builds_only_the_train_split_and_once(spark, monkeypatch):
    """no test pairs are made for the search, and its table is built once for all rounds."""
    splits_run = []
    monkeypatch.setattr(model_queries, "run_split", lambda v, c, is_test, *a: splits_run.append(is_test) or (v, None))
    monkeypatch.setattr(model_queries, "split_visits", lambda v, *a, **b: v.withColumn("split", F.lit("train")))
    model_queries._train_features(spark, "/root/testdata/sf0.001")
    assert splits_run == [False]
    kept, write = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda d, n: kept.append(n) or write(d, n))
    monkeypatch.setattr(search, "_sample", lambda d, *a: (_ for _ in ()).throw(StopIteration(d)))
    from headway.ml import models
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("tt"))
    pipe = models.regressor_pipeline(["k"], [], "tt", dict(models.ETA_PARAMS, maxIter=2))
    try:
        search.halving_search(df, pipe, "tt", ["id"], trials=2, fractions=(0.2, 0.4), rounds=1)
    except (StopIteration, RuntimeError):
        pass
    assert kept == ["largest"]
