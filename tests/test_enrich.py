from pyspark.sql import functions as F

from headway.operators import enrich
from headway.sources.readers import holidays_table


def test_active_service_days(spark):
    cal = spark.createDataFrame([
        ("S1", "1", "1", "1", "1", "1", "0", "0", "20240101", "20241231"),   # weekdays
        ("S2", "1", "1", "1", "1", "1", "1", "1", "20240111", "20240120"),   # starts mid-window
        ("S3", "1", "1", "1", "1", "1", "1", "1", "20231201", "20231231"),   # ended
    ], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, "
       "saturday string, sunday string, start_date string, end_date string")
    got = {}
    for r in enrich.active_service_days(cal, "2024-01-08", 8).collect():
        got.setdefault(r["service_id"], []).append(str(r["service_date"]))
    assert sorted(got["S1"]) == ["2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11", "2024-01-12", "2024-01-15"]
    assert sorted(got["S2"]) == ["2024-01-11", "2024-01-12", "2024-01-13", "2024-01-14", "2024-01-15"]
    assert "S3" not in got


def test_unroll_trip_date_id(spark):
    active = spark.createDataFrame([("S1", "2024-01-08")], "service_id string, d string").select(
        "service_id", F.to_date("d").alias("service_date"))
    trips = spark.createDataFrame([("T1", "S1"), ("T2", "S9")], "trip_id string, service_id string")
    st = spark.createDataFrame([("T1", 1), ("T1", 2), ("T3", 1)], "trip_id string, stop_sequence int")
    out = enrich.unroll_calendar(active, trips, st).collect()
    assert sorted((r["trip_date_id"], r["stop_sequence"]) for r in out) == [("T1_20240108", 1), ("T1_20240108", 2)]


def test_holiday_local_date(spark):
    hol = holidays_table(spark, [("US-MA", "2024-01-01")])
    df = spark.createDataFrame([("2024-01-01 02:00:00",), ("2024-01-01 12:00:00",)], "t string").withColumn(
        "t", F.to_timestamp("t"))
    utc = [r["is_holiday"] for r in enrich.holiday_flag(df, hol, "t").orderBy("t").collect()]
    ny = [r["is_holiday"] for r in enrich.holiday_flag(df, hol, "t", "America/New_York").orderBy("t").collect()]
    assert utc == [1.0, 1.0] and ny == [0.0, 1.0]   # 02:00 UTC is still Dec 31 in New York


def test_distance_join_multiplies_and_fills(spark):
    arr = spark.createDataFrame([(1, "s1"), (2, "s2")], "id int, stop_id string")
    stops = spark.createDataFrame([("s1", 1.5), ("s1", 2.5), ("s3", None)], "stop_id string, distance_from_prev_km double")
    got = sorted((r["id"], r["distance_from_prev_km"]) for r in enrich.attach_distance(arr, stops).collect())
    assert got == [(1, 1.5), (1, 2.5), (2, 0.0)]


def test_baseline_first_wins_and_default(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, k1 string, k2 int")
    base = spark.createDataFrame([("a", 1, 5.0, 2), ("a", 1, 9.0, 1)], "k1 string, k2 int, v double, ord int")
    got = sorted((r["id"], r["v"]) for r in enrich.attach_baseline(df, base, ["k1", "k2"], "v", ["ord"]).collect())
    assert got == [(1, 9.0), (2, 0.0)]


def test_role_playing_inner_drop(spark):
    legs = spark.createDataFrame([(1, "a", "b"), (2, "a", "zz"), (3, None, "b")], "id int, o string, d string")
    stops = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), (None, 0.0, 0.0)],
                                  "stop_id string, stop_lat double, stop_lon double")
    out = enrich.attach_od_stops(legs, stops, "o", "d").collect()
    assert [(r["id"], r["o_stop_lat"], r["d_stop_lat"]) for r in out] == [(1, 1.0, 3.0)]


def test_weather_hour_join_and_fill(spark):
    w = spark.createDataFrame([("2024-01-01 10:00:00", None, 1.0, 0.0), ("2024-01-01 09:00:00", 5.0, 0.0, 0.0)],
                              "h string, temperature_2m double, precipitation double, snowfall double").select(
        F.to_timestamp("h").alias("hour_key"), "temperature_2m", "precipitation", "snowfall")
    filled = {str(r["hour_key"]): r["temperature_2m"] for r in enrich.fill_weather(w).collect()}
    assert filled["2024-01-01 10:00:00"] == 5.0
    df = spark.createDataFrame([("2024-01-01 10:30:00",), ("2024-01-01 11:30:00",)], "t string").withColumn(
        "t", F.to_timestamp("t"))
    r = enrich.attach_weather_hour(df, w, "t", fill={"precipitation": 0.0}).orderBy("t").collect()
    assert [(x["temperature_2m"], x["precipitation"]) for x in r] == [(None, 1.0), (None, 0.0)]


def test_checked_broadcast(spark):
    small = spark.range(10)
    big_side = spark.range(1000).withColumnRenamed("id", "id")
    plan = big_side.join(enrich.checked_broadcast(small), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    assert enrich.estimated_bytes(small) is not None
    assert enrich.checked_broadcast(small, max_bytes=0) is small   # over the limit: no hint
