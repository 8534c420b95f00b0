import json
import os
import tempfile

from pyspark.sql import functions as F

from headway.sources import readers, sinks


def write(path, text, enc="utf-8"):
    with open(path, "w", encoding=enc) as f:
        f.write(text)


def test_stops_keep_first_and_bad_coords(spark):
    d = tempfile.mkdtemp(prefix="stops-")
    write(os.path.join(d, "stops.txt"), "stop_id,stop_name,stop_lat,stop_lon\ns1,A,1.5,2.5\ns1,A2,9,9\ns2,B,x,3\n")
    r = {x["stop_id"]: (x["stop_lat"], x["stop_lon"]) for x in readers.read_stops(spark, d + "/stops.txt").collect()}
    assert r == {"s1": (1.5, 2.5), "s2": (None, 3.0)}


def test_gtfs_bundle_and_encoding_fallback(spark):
    d = tempfile.mkdtemp(prefix="gtfs-")
    write(os.path.join(d, "routes.txt"), "route_id,route_short_name,route_long_name,route_type\nR1,1,Çarşı,3\n",
          enc="iso-8859-9")
    write(os.path.join(d, "trips.csv"), "route_id,service_id,trip_id,direction_id,shape_id\nR1,S,T1,,SH\n")
    g = readers.read_gtfs(spark, d, ["routes", "trips"], encoding_fallback=True)
    assert set(g) == {"routes", "trips"}
    assert g["routes"].first()["route_long_name"] == "Çarşı"
    assert g["trips"].first()["direction_id"] is None


def test_weather_json_and_arrays(spark):
    doc = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None],
                      "precipitation": [0.0, 0.2], "snowfall": [0.0, 0.0]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "json string")
    rows = readers.weather_from_json(df).orderBy("hour_key").collect()
    assert [(str(r["hour_key"]), r["temperature_2m"]) for r in rows] == [("2024-01-01 00:00:00", 1.5),
                                                                          ("2024-01-01 01:00:00", None)]
    arr = spark.createDataFrame([(1704067200, 3600, [1.0, 2.0, 3.0])], "start long, interval_s int, temperature_2m array<double>")
    r2 = readers.weather_from_arrays(arr).orderBy("hour_key").collect()
    assert [r["temperature_2m"] for r in r2] == [1.0, 2.0, 3.0] and str(r2[2]["hour_key"]) == "2024-01-01 02:00:00"


def test_state_roundtrip_and_partitioned_write(spark):
    st = spark.createDataFrame([("r", "a", "b", 10, 2)], "route_id string, o string, d string, sum_tt long, n long")
    back = sinks.persist_state(spark, st, "test-state")
    assert back.collect() == st.collect()
    out = tempfile.mkdtemp(prefix="k-") + "/feat"
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 3.0)], "k int, x double")
    sinks.write_by_horizon(df, out)
    assert sorted(x for x in os.listdir(out) if x.startswith("k=")) == ["k=1", "k=2"]
    read = readers.read_features(spark, out)
    assert read.where(F.col("k") == 2).count() == 2


def test_arrivals_csv(spark):
    d = tempfile.mkdtemp(prefix="arr-")
    write(os.path.join(d, "a_2024_01.csv"), ",".join(readers.ARRIVAL_COLS) + "\n"
          "2024-03-10,39,0,h1,s1,1,Startpoint,Schedule,1900-01-01T05:00:00Z,1900-01-01T05:10:00Z\n"
          "2024-03-10,39,0,h1,s2,x,Midpoint,Schedule,,1900-01-01T05:20:00Z\n")
    df = readers.read_arrivals(spark, d + "/*2024*.csv")
    rows = df.orderBy("stop_id").collect()
    assert [r["time_point_order"] for r in rows] == [1, None]


def test_gtfs_separator_and_missing_columns(spark, tmp_path):
    import pytest
    (tmp_path / "trips.csv").write_text("trip_id;route_id;extra\nT1;R1;x\n")
    (tmp_path / "stops.txt").write_text("stop_id,stop_name\ns1,A\n")
    g = readers.read_gtfs(spark, str(tmp_path), ["trips"], seps={"trips": ";"})["trips"].first()
    assert (g["trip_id"], g["route_id"], g["direction_id"]) == ("T1", "R1", None)
    with pytest.raises(ValueError, match="stop_lat"):
        readers.read_gtfs(spark, str(tmp_path), ["stops"])
