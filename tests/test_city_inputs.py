"""Raw inputs -> visits -> the C3 feature ETL, per city configuration."""
from pyspark.sql import functions as F

from headway.config import city
from headway.plans import city_etl, city_inputs


def test_pings_to_features(spark):
    base = 1704103200  # 2024-01-01 10:00:00 UTC
    rows = []
    for v in ("bus1", "bus2"):
        for i in range(12):
            rows.append((len(rows), v, "R1", None if i == 0 else f"S{i}", 43.65 + i * 0.001, -79.38, base + i * 60 + 5))
    rows.append((len(rows), "bus1", "R1", "S99", 43.70, -79.38, base + 30))       # same minute as the first ping
    df = spark.createDataFrame(rows, "id long, vehicle_id string, route_id string, current_stop_id string, "
                                     "current_lat double, current_lon double, timestamp long")
    v = city_inputs.pings_to_visits(df)
    first = v.where("vehicle_id = 'bus1'").orderBy("t_us").first()
    assert first["stop_id"] == "S99" and first["direction_id"] == "0"       # first non-null stop of the minute
    assert v.count() == 24                                                 # one visit per vehicle-minute
    feats, state = city_etl.run_split(v, city("toronto"), is_test=False)
    assert feats.count() > 0 and state.count() > 0
    assert feats.where("tiempo_viaje_segundos <= 0 OR tiempo_viaje_segundos > 7200").count() == 0


def test_arrivals_dst_and_features(spark):
    rows = [("2024-03-10", "39", "0", "h1", "s1", 1, "1900-01-01T05:00:00Z"),
            ("2024-03-10", "39", "0", "h1", "s2", 2, "1900-01-01T05:10:00Z"),
            ("2024-03-10", "39", "0", "h1", "s3", 3, "bad"),
            ("2024-03-10", "39", "0", "h1", "s4", 4, "1900-01-01T05:30:00Z")]
    arr = spark.createDataFrame(rows, "service_date string, route_id string, direction_id string, half_trip_id string, "
                                      "stop_id string, time_point_order int, actual string")
    stops = spark.createDataFrame([("s1", 42.35, -71.06), ("s2", 42.36, -71.06), ("s4", 42.38, -71.06)],
                                  "stop_id string, stop_lat double, stop_lon double")
    v = city_inputs.arrivals_to_visits(arr, stops)
    got = sorted(r["t_us"] // 1_000_000 for r in v.collect())
    assert len(got) == 3 and got[0] == 1710046800 + 5 * 3600     # local midnight (EST) + 5 h, bad clock dropped
    feats, _ = city_etl.run_split(v, city("boston"), is_test=False)
    hops = sorted(r["num_paradas_salto"] for r in feats.collect())
    assert hops == [1.0, 2.0, 3.0]        # hops = order gap (s3 dropped: 1->2, 2->4, 1->4)


def test_stop_times_interpolated(spark):
    st = spark.createDataFrame([("T1", "a", "1", "08:00:00"), ("T1", "b", "2", ""), ("T1", "c", "3", "08:10:00"),
                                ("T1", "d", "4", None)], "trip_id string, stop_id string, stop_sequence string, "
                                                         "arrival_time string")
    stops = spark.createDataFrame([("a", "410082", "289000"), ("b", "41.01", "28.91"), ("c", "41.02", "28.92"),
                                   ("d", "41.03", "28.93")], "stop_id string, stop_lat string, stop_lon string")
    trips = spark.createDataFrame([("T1", "R", None)], "trip_id string, route_id string, direction_id string")
    v = city_inputs.stop_times_to_visits({"stop_times": st, "stops": stops, "trips": trips}).orderBy("seq").collect()
    secs = [r["t_us"] // 1_000_000 for r in v]
    assert secs == [28800, 29100, 29400, 29400]                 # gap filled by position, trailing takes last
    assert abs(v[0]["lat"] - 41.0082) < 1e-5 and v[0]["direction_id"] == "0"
    feats, _ = city_etl.run_split(spark.createDataFrame(v), city("istanbul"), is_test=False)
    assert feats.where(F.col("tiempo_viaje_segundos") > 0).count() == feats.count() > 0


def test_leg_input_pairs_off_by_one(spark):
    """Leg rows: k = 1 pairs leg i's origin with leg i+1's destination (two physical hops)."""
    from headway.plans import leg_logs
    cols = "arac_no string, ana_hat_no string, o string, d string, dep string, arr string"
    t = lambda m: f"2024-05-01 08:{m:02d}:00"
    raw = spark.createDataFrame([("V", "R", "A", "B", t(0), t(2)), ("V", "R", "B", "C", t(3), t(5)),
                                 ("V", "R", "C", "D", t(6), t(8))], cols)
    legs = leg_logs.clean_legs(raw, "arac_no", "ana_hat_no", "o", "d", "dep", "arr")
    stops = spark.createDataFrame([(s, 37.87, 32.48 + i * 0.01) for i, s in enumerate("ABCD")],
                                  "stop_id string, stop_lat double, stop_lon double")
    legs = leg_logs.rebuild_trips(leg_logs.leg_features(leg_logs.collapse_repeats(legs), stops))
    v = city_inputs.legs_to_visits(legs)
    feats, _ = city_etl.run_split(v, city("konya"), is_test=False)
    got = sorted((r["stop_id_origen"], r["stop_id_destino"], r["k"], r["tiempo_viaje_segundos"]) for r in feats.collect())
    assert got == [("A", "C", 1, 300.0), ("A", "D", 2, 480.0), ("B", "D", 1, 300.0)]
    test_feats, _ = city_etl.run_split(v, city("konya"), is_test=True)
    assert sorted((r["stop_id_origen"], r["stop_id_destino"]) for r in test_feats.collect()) == \
        [("A", "C"), ("A", "D"), ("B", "D")]


def test_raw_rows_split_before_bins(spark):
    """A minute cut by the split gives a visit in each split; the others cut visits."""
    base = 1704103200
    rows = [(i, "bus", "R", f"S{i}", 43.65, -79.38, base + i * 20) for i in range(10)]      # 80 % ends inside a minute
    df = spark.createDataFrame(rows, "id long, vehicle_id string, route_id string, current_stop_id string, "
                                     "current_lat double, current_lon double, timestamp long")
    train, test = city_etl.visits_by_split(df, city("toronto"), city_inputs.pings_to_visits, ["timestamp", "id"])
    stops = lambda d: [r["stop_id"] for r in d.orderBy("t_us").collect()]
    assert stops(train) == ["S0", "S3", "S6"] and stops(test) == ["S8", "S9"]


def test_every_hour_is_filled(spark):
    from headway.operators import enrich
    w = spark.sql("SELECT timestamp'2024-01-01 03:00' AS hour_key, 5.0D AS temperature_2m")
    facts = spark.sql("SELECT timestamp'2024-01-01 01:30' AS ts UNION ALL SELECT timestamp'2024-01-01 05:10'")
    got = enrich.fill_weather(enrich.every_hour(w, facts, "ts")).orderBy("hour_key").collect()
    assert [(r["hour_key"].hour, r["temperature_2m"]) for r in got] == [(h, 5.0) for h in range(1, 6)]
    assert enrich.every_hour(w.limit(0), facts.limit(0), "ts").count() == 0


def test_needed_hours_fill_as_the_whole_range_does(spark):
    from pyspark.sql import functions as F

    from headway.operators import enrich
    w = spark.sql("SELECT timestamp'2024-01-01 03:00' AS hour_key, 5.0D AS temperature_2m UNION ALL "
                  "SELECT timestamp'2024-01-01 07:00', NULL UNION ALL SELECT timestamp'2024-01-01 09:00', 7.0D")
    facts = spark.sql("SELECT timestamp'2024-01-01 01:30' AS ts UNION ALL SELECT timestamp'2024-01-01 08:10' "
                      "UNION ALL SELECT timestamp'2024-01-01 08:50' UNION ALL SELECT timestamp'2024-01-02 05:10' UNION ALL SELECT NULL")
    rows = lambda d: {r["hour_key"]: r["temperature_2m"] for r in enrich.fill_weather(d).collect()}
    few, whole = rows(enrich.needed_hours(w, facts, "ts")), rows(enrich.every_hour(w, facts, "ts"))
    assert few.items() <= whole.items()
    assert sorted((h.day, h.hour) for h in few) == [(1, 1), (1, 3), (1, 7), (1, 8), (1, 9), (2, 5)]
    wrong = facts.unionByName(spark.sql("SELECT timestamp'9999-01-01 00:00' AS ts"))
    assert enrich.needed_hours(w, wrong, "ts").count() == 7
    assert enrich.needed_hours(w.limit(0), facts.where(F.lit(False)), "ts").count() == 0
