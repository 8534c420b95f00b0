"""Leg-log rules on the FIXTURES.md F5 edge cases."""
from pyspark.sql import functions as F

from headway.plans import leg_logs

COLS = "arac_no string, ana_hat_no string, baslangic_durak_no string, bitis_durak_no string, cikis_zaman string, varis_zaman string"


def t(m, s=0):
    return f"2024-05-01 08:{m:02d}:{s:02d}"


def test_collapse_and_min_leg(spark):
    rows = [
        ("V1", "R", "A", "B", t(0), t(1)), ("V1", "R", "A", "B", t(1), t(2)),   # contiguous repeat -> one leg
        ("V1", "R", "B", "A", t(3), t(4)), ("V1", "R", "A", "B", t(5), t(6)),   # A,B,A -> three islands
        ("V1", "R", " C ", "D", t(7), t(7, 29)),                               # 29 s: dropped (and trimmed)
        ("V1", "R", "D", "E", t(8), t(8, 30)),                                 # exactly 30 s: kept
        ("V1", "R", "", "F", t(9), t(10)),                                      # blank id: dropped
        ("V1", "R", "F", "G", "not a time", t(11)),                            # bad time: dropped
        ("V2", None, "A", "B", t(0), t(1)), ("V2", None, "A", "B", t(2), t(3)),  # null route twice: two legs (N4)
    ]
    raw = spark.createDataFrame(rows, COLS)
    legs = leg_logs.clean_legs(raw, "arac_no", "ana_hat_no", "baslangic_durak_no", "bitis_durak_no",
                               "cikis_zaman", "varis_zaman")
    out = leg_logs.collapse_repeats(legs).orderBy("vehicle_id", "cikis_zaman").collect()
    got = [(r["vehicle_id"], r["stop_id_origen"], r["stop_id_destino"], r["tiempo_viaje_base"]) for r in out]
    assert got == [("V1", "A", "B", 120.0), ("V1", "B", "A", 60.0), ("V1", "A", "B", 60.0), ("V1", "D", "E", 30.0),
                   ("V2", "A", "B", 60.0), ("V2", "A", "B", 60.0)]


def test_rebuild_trips(spark):
    rows = [
        ("V1", "R", "A", "B", t(0), t(1)),
        ("V1", "R", "B", "C", t(16), t(17)),          # 900 s after the previous arrival: same trip
        ("V1", "R", "C", "D", t(32, 1), t(33)),       # 901 s: new trip
        ("V1", "R", "X", "Y", t(34), t(35)),          # origin != previous destination: new trip
        ("V1", "S", "Y", "Z", t(36), t(37)),          # route change: new trip
    ]
    legs = leg_logs.clean_legs(spark.createDataFrame(rows, COLS), "arac_no", "ana_hat_no", "baslangic_durak_no",
                               "bitis_durak_no", "cikis_zaman", "varis_zaman")
    got = [r["trip_id"] for r in leg_logs.rebuild_trips(legs).orderBy("cikis_zaman").collect()]
    assert got == ["V1_1", "V1_1", "V1_2", "V1_3", "V1_4"]


def test_leg_features_inner_roles_and_lags(spark):
    rows = [("V1", "R", "A", "B", t(0), t(1)), ("V1", "R", "B", "C", t(2), t(4)), ("V1", "R", "C", "Q", t(5), t(6))]
    legs = leg_logs.clean_legs(spark.createDataFrame(rows, COLS), "arac_no", "ana_hat_no", "baslangic_durak_no",
                               "bitis_durak_no", "cikis_zaman", "varis_zaman")
    legs = leg_logs.collapse_repeats(legs)
    stops = spark.createDataFrame([("A", 0.0, 0.0), ("B", 0.0, 0.01), ("C", 0.0, 0.02)],
                                  "stop_id string, stop_lat double, stop_lon double")
    out = leg_logs.leg_features(legs, stops).orderBy("cikis_zaman").collect()
    assert [r["stop_id_destino"] for r in out] == ["B", "C"]       # unknown stop Q dropped (inner)
    assert out[0]["vel_lag_1"] == 0.0
    assert abs(out[1]["vel_lag_1"] - 1111.9492664455872 / 60) < 1e-9
