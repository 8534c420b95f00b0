import datetime as dt
import tempfile

from pyspark.sql import functions as F

from headway.session import scratch_path
from headway.streaming import feed, live_eta, lookup


def test_normalize_positions(spark):
    rows = [
        {"id": "e1", "vehicle": {"vehicle": {"id": "V1"}, "trip": {"route_id": "39"},
                                 "position": {"latitude": 42.1, "longitude": -71.0}, "timestamp": 1700000000,
                                 "current_status": "1"}},
        {"id": "e2", "vehicle": {"vehicle": {"id": ""}, "trip": {"route_id": "39"},
                                 "position": {"latitude": 42.2, "longitude": -71.1}, "timestamp": 0,
                                 "current_status": "weird"}},
        {"id": "e3", "vehicle": None},
    ]
    df = spark.createDataFrame(rows, feed.POSITION_SCHEMA)
    out = feed.normalize_positions(df, now=F.lit(123)).orderBy("vehicle_id").collect()
    assert [(r["vehicle_id"], r["timestamp"], r["current_status"]) for r in out] == [
        ("V1", "1700000000", "STOPPED_AT"), ("e2", "123", "IN_TRANSIT_TO")]
    assert all(isinstance(r["latitude"], str) for r in out)


def _scored(spark, rows):
    schema = ("route_id string, stop_id string, next_stop_id string, direction_id string, eta_segundos double, "
              "nivel_confianza double, hora_del_dia int, dia_semana int, mes int, temperatura_actual_c double, "
              "precipitacion_mm double, nieve_cm double, ultima_actualizacion timestamp, event_id long")
    return spark.createDataFrame(rows, schema)


def row(eta, ts, eid, key=("39", "s1", "s2")):
    return (*key, "0", eta, 0.8, 8, 0, 1, 10.0, 0.0, 0.0, ts, eid)


def test_live_table_latest_wins_and_replay(spark):
    root = scratch_path(spark, "live-test")
    t = live_eta.LiveTable(spark, root)
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    assert t.apply(_scored(spark, [row(60.0, t0, 1), row(70.0, t0 + dt.timedelta(seconds=10), 2)]), 0)
    assert t.apply(_scored(spark, [row(50.0, t0 - dt.timedelta(seconds=30), 3)]), 1)   # older event, later batch
    assert t.read().first()["eta_segundos"] == 70.0
    assert not t.apply(_scored(spark, [row(99.0, t0 + dt.timedelta(hours=1), 4)]), 1)  # replay: skipped
    assert t.read().first()["event_id"] == 2 and t.current_version() == 1


def test_ttl_and_lookup(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    live = _scored(spark, [row(60.0, t0 - dt.timedelta(seconds=299), 1, ("39", "a", "b")),
                           row(61.0, t0 - dt.timedelta(seconds=301), 2, ("39", "c", "d"))])
    now = F.lit(t0).cast("timestamp")
    assert [r["event_id"] for r in live_eta.live_view(live, now).collect()] == [1]
    req = spark.createDataFrame([(1, "39", "a", "b"), (2, "39", "c", "d"), (3, "39", "x", "y")],
                                "request_id int, route_id string, stop_id string, next_stop_id string")
    got = {r["request_id"]: (r["status"], r["eta_segundos"]) for r in lookup.lookup_eta(req, live, now).collect()}
    assert got == {1: ("found", 60.0), 2: ("expired", 0.0), 3: ("not_found", 0.0)}


def test_scorer_stream_end_to_end(spark):
    landing = tempfile.mkdtemp(prefix="stop-events-")
    msgs = spark.createDataFrame([
        ("1", " 39 ", "0", "s1", "s2", "h", "2024-01-01T08:00:00"),
        ("2", "39", "0", "", "s2", "h", "2024-01-01T08:05:00"),          # rejected (empty stop)
        ("3", "39", "0", "s1", "s2", "h", "2024-01-01T09:00:00+03:00"),  # 06:00 UTC, older than event 1
    ], live_eta.STOP_EVENT_SCHEMA)
    msgs.coalesce(1).write.mode("append").json(landing)
    root, ck, dl = (scratch_path(spark, n) for n in ("live", "live-ck", "dead"))
    q = live_eta.start_scorer(spark, live_eta.read_stop_events(spark, landing), root, ck, dead_letter=dl,
                              available_now=True)
    q.awaitTermination()
    out = live_eta.LiveTable(spark, root).read().collect()
    assert len(out) == 1 and out[0]["route_id"] == "39" and out[0]["event_id"] == "1"
    assert out[0]["eta_segundos"] == 80.0 and out[0]["nivel_confianza"] == 0.63   # 40 + 5*8, rush hour
    assert spark.read.json(dl).count() == 1


def test_retention_and_presets(spark):
    from headway.operators.enrich import weather_presets
    log = spark.createDataFrame([(str(i), str(1000 + i)) for i in range(50)], "vehicle_id string, timestamp string")
    kept = sorted(int(r["timestamp"]) for r in feed.retain_newest(log, 5).collect())
    assert kept == [1045, 1046, 1047, 1048, 1049]
    assert {r["preset"]: r["precipitation"] for r in weather_presets(spark).collect()}["Rain"] == 12.0
    assert feed.latest_position(log.withColumn("vehicle_id", F.lit("v"))).first()["timestamp"] == "1049"


def test_fitted_model_scores_the_stream_and_totals(spark):
    from headway.ml import models
    base = spark.range(300).select(
        (F.col("id") % 24).cast("double").alias("hora_del_dia"), (F.col("id") % 7).cast("double").alias("dia_semana"),
        F.lit(1.0).alias("mes"), F.lit(10.0).alias("temperature_2m"), F.lit(0.0).alias("precipitation"),
        F.lit(0.0).alias("snowfall"), F.lit("39").alias("route_id"), F.lit("0").alias("direction_id"),
        F.lit("s1").alias("stop_id"), F.lit("s2").alias("next_stop_id"))
    train = base.withColumn("eta", 100 + 10 * F.col("hora_del_dia"))
    numeric = ["hora_del_dia", "dia_semana", "mes", "temperature_2m", "precipitation", "snowfall"]
    model = models.regressor_pipeline(numeric, ["route_id", "direction_id", "stop_id", "next_stop_id"], "eta",
                                      dict(models.ETA_PARAMS, maxIter=30, minInstancesPerNode=2)).fit(train)
    path = scratch_path(spark, "stream-model")
    models.save_model(model, path)
    landing, totals = scratch_path(spark, "model-events"), scratch_path(spark, "totals")
    spark.createDataFrame([
        ("1700000000-0", "39", "0", "s1", "s2", "h", "2024-01-01T08:00:00"),
        ("1700000000-1", "39", "0", "new", "s2", "h", "2024-01-01T20:00:00"),      # a stop that training lacks
        ("1700000000-2", "39", "0", None, "s2", "h", "2024-01-01T08:00:00"),       # rejected
    ], live_eta.STOP_EVENT_SCHEMA).write.json(landing)
    root, ck = scratch_path(spark, "live-model"), scratch_path(spark, "live-model-ck")
    live_eta.start_scorer(spark, live_eta.read_stop_events(spark, landing), root, ck, available_now=True, totals=totals,
                          predict=models.load_model(path).transform).awaitTermination()
    got = {r["stop_id"]: r["eta_segundos"] for r in live_eta.LiveTable(spark, root).read().collect()}
    assert abs(got["s1"] - 180) < 20 and abs(got["new"] - 300) < 30
    assert live_eta.scorer_totals(spark, totals).first().asDict() == {"received": 3, "accepted": 2, "rejected": 1}


def test_retained_keys(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    t = live_eta.LiveTable(spark, scratch_path(spark, "live-retain"), retain_s=300)
    t.apply(_scored(spark, [row(60.0, t0, 1), row(61.0, t0, 2, ("39", "a", "b"))]), 0)
    t.apply(_scored(spark, [row(62.0, t0 + dt.timedelta(seconds=301), 3)]), 1)
    assert [(r["stop_id"], r["event_id"]) for r in t.read().collect()] == [("s1", 3)]
