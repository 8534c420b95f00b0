"""Golden values for the Column helpers (FIXTURES.md, 'Golden values')."""
import math

import pytest
from pyspark.sql import functions as F

from headway.functions import geo, scalars, timefmt


def one(spark, col, data="select 1 as d"):
    return spark.sql(data).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("txt,sec", [("08:30:00", 30600), ("25:05:00", 90300), (" 00:00:01 ", 1),
                                     ("8:5", None), ("", None), ("aa:00:00", None), (None, None)])
def test_clock_to_seconds(spark, txt, sec):
    df = spark.createDataFrame([(txt,)], "c string")
    assert df.select(timefmt.clock_to_seconds("c")).first()[0] == sec


def test_clock_raise_mode(spark):
    df = spark.createDataFrame([("8:5",)], "c string")
    with pytest.raises(Exception):
        df.select(timefmt.clock_to_seconds("c", on_error="raise")).collect()
    ok = spark.createDataFrame([("25:05:00",)], "c string")
    assert ok.select(timefmt.clock_to_seconds("c", on_error="raise")).first()[0] == 90300


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (41.0, 29.0, 41.0, 29.0)], "a double, b double, c double, d double")
    r = [x[0] for x in df.select(geo.haversine_m("a", "b", "c", "d")).collect()]
    assert abs(r[0] - 111194.93) < 0.01
    assert r[1] == 0.0


@pytest.mark.parametrize("raw,val", [("410082", 41.0082), ("41.008.238", 41.008238), ("-41.5", 41.5),
                                     ("4", None), (None, None), ("29", 29.0)])
def test_repair_coord(spark, raw, val):
    df = spark.createDataFrame([(raw,)], "c string")
    got = df.select(geo.repair_coord("c")).first()[0]
    assert (got is None and val is None) or math.isclose(got, val)


def test_confidence_golden(spark):
    df = spark.createDataFrame([(12, 0, 30.0, 0.0, 0.0), (8, 5, 1000.0, 6.0, 3.0), (3, 0, 100.0, 0.0, 0.0)],
                               "h int, d int, e double, p double, s double")
    got = [r[0] for r in df.select(scalars.confidence("h", "d", "e", "p", "s")).collect()]
    assert got == [0.85, 0.23, 0.75]


def test_confidence_clamp(spark):
    df = spark.createDataFrame([(8, 6, 1000.0, 9.0, 9.0)], "h int, d int, e double, p double, s double")
    low = df.select(scalars.confidence("h", "d", "e", "p", "s")).first()[0]
    assert 0.10 <= low <= 0.99


@pytest.mark.parametrize("k,segs", [(16, [8, 8]), (25, [13, 12]), (31, [11, 10, 10]), (15, [15]), (1, [1])])
def test_segment_sizes(spark, k, segs):
    df = spark.createDataFrame([(k,)], "k int")
    assert df.select(scalars.segment_sizes("k", 15)).first()[0] == segs


def test_eta_postprocess_and_safe_float(spark):
    df = spark.createDataFrame([(-5.0, "x"), (12.25, "3.5"), (12.35, None)], "p double, s string")
    r = df.select(scalars.eta_postprocess("p"), scalars.safe_float("s")).collect()
    assert [x[0] for x in r] == [1.0, 12.2, 12.4]   # half-even on the decimal value
    assert [x[1] for x in r] == [0.0, 3.5, 0.0]


def test_safe_ratio_no_error(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(scalars.safe_ratio("a", "b")).collect()] == [0.0, 0.0, 2.0]


def test_calendar_monday_zero(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    h, d, m = df.select(*timefmt.calendar_features("t")).first()
    assert (h, d, m) == (10, 0, 1)                      # 2024-01-01 is a Monday
    h2, d2, _ = df.select(*timefmt.calendar_features("t", "America/New_York")).first()
    assert (h2, d2) == (5, 0)


def test_event_time_parse(spark):
    df = spark.createDataFrame([("2024-03-10T08:15:00",), ("2024-03-10T08:15:00+03:00",), ("garbage",)], "s string")
    rows = df.select(*timefmt.parse_event_time("s")).collect()
    assert rows[0]["hora_del_dia"] == 8 and rows[0]["dia_semana"] == 6
    assert rows[1]["hora_del_dia"] == 8                  # the offset's own wall clock
    assert rows[1]["event_ts"] != rows[0]["event_ts"]
    assert rows[2]["event_ts"] is not None               # bad input falls back to now


def test_yyyymmdd_and_weekday(spark):
    df = spark.createDataFrame([("20240108",), ("2024-01-08",)], "s string")
    r = df.select(timefmt.parse_yyyymmdd("s").alias("d")).collect()
    assert str(r[0]["d"]) == "2024-01-08" and r[1]["d"] is None
    assert spark.createDataFrame([("2024-01-08",)], "s string").select(
        timefmt.weekday_name(F.to_date("s"))).first()[0] == "monday"


def test_date_plus_clock_rolls_over(spark):
    df = spark.createDataFrame([("2024-01-08", 90300)], "d string, s long")
    v = df.select(timefmt.date_plus_clock("d", "s")).first()[0]
    assert str(v) == "2024-01-09 01:05:00"


def test_epoch1900_clock_dst(spark):
    df = spark.createDataFrame([("2024-03-10", "1900-01-01 05:10:00")], "d string, c string")
    v = df.select(F.unix_seconds(timefmt.epoch1900_clock_to_instant("d", F.to_timestamp("c"), "America/New_York"))).first()[0]
    # local midnight 2024-03-10 is 05:00 UTC (EST), plus 5 h 10 min of absolute time
    assert v == 1710046800 + 5 * 3600 + 600


def test_segments_sum_to_k(spark):
    df = spark.range(1, 200).withColumnRenamed("id", "k")
    bad = df.select("k", scalars.segment_sizes("k", 15).alias("s")).where(
        (F.aggregate("s", F.lit(0), lambda a, x: a + x) != F.col("k"))
        | (F.array_max("s") > 15) | (F.array_max("s") - F.array_min("s") > 1)).count()
    assert bad == 0
