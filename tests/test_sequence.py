"""Sequence operators against golden fixtures and independent loop models.

Each test runs on the three plan routes (single window, hot entities split out and
chunked, everything chunked), which must agree exactly.
"""
import math
import random

import pytest
from pyspark.sql import functions as F

from headway.operators import sequence


@pytest.fixture(params=["plain", "split", "chunk_all"])
def path(request):
    """plain: no hot entity; split: hot entities chunked (3-row chunks), the rest in one
    window each; chunk_all: every entity is hot."""
    old = sequence.CHUNK_ROWS
    sequence.CHUNK_ROWS = {"plain": 1 << 20, "split": 3, "chunk_all": 0}[request.param]
    yield request.param
    sequence.CHUNK_ROWS = old


def rand_events(seed=7, n_ent=4, n=60, null_ent=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        e = rnd.randrange(n_ent)
        ent = None if (null_ent and i % 17 == 0) else f"v{e}"
        rows.append((i, ent, rnd.randrange(0, 10_000), rnd.choice(["A", "B", None]),
                     None if i % 5 == 0 else float(rnd.randrange(100))))
    return rows


SCHEMA = "id long, ent string, t long, stop string, val double"


def groups(rows):
    g = {}
    for r in rows:
        if r[1] is not None:
            g.setdefault(r[1], []).append(r)
    for k in g:
        g[k].sort(key=lambda r: (r[2], r[0]))
    return g


def test_speed_lags_golden(spark, path):
    # points 1 km apart (approx) with times giving speeds null(first), 5, 6, 7 m/s
    lat = [0.0, 0.0, 0.0, 0.0]
    lon = [0.0, 0.01, 0.02, 0.03]
    d = 1111.9492664455872  # haversine of 0.01 deg of longitude at the equator
    ts = [0.0, d / 5, d / 5 + d / 6, d / 5 + d / 6 + d / 7]
    df = spark.createDataFrame([(i, "v", lat[i], lon[i], ts[i]) for i in range(4)],
                               "id long, ent string, lat double, lon double, t double")
    r = sequence.speed_lags(df, "ent", ["t", "id"], "lat", "lon", "t").orderBy("id").collect()
    assert [round(x["vel_lag_1"], 6) for x in r] == [0.0, 0.0, 5.0, 6.0]
    assert [round(x["vel_lag_2"], 6) for x in r] == [0.0, 0.0, 0.0, 5.0]


def test_previous_and_next(spark, path):
    rows = rand_events()
    df = spark.createDataFrame(rows, SCHEMA)
    prev = {r["id"]: r["prev_id"] for r in sequence.previous_values(df, "ent", ["t", "id"], ["id"]).collect()}
    nxt = {r["id"]: r["next_id"] for r in sequence.next_leg(df, "ent", ["t", "id"], ["id"]).collect()}
    exp_prev, exp_next = {}, {}
    for g in groups(rows).values():
        for i, r in enumerate(g):
            exp_prev[r[0]] = g[i - 1][0] if i else None
            if i + 1 < len(g):
                exp_next[r[0]] = g[i + 1][0]
    for r in rows:
        if r[1] is None:
            exp_prev[r[0]] = None
    assert prev == exp_prev
    assert nxt == exp_next                       # last row of each entity dropped, nulls never pair


def test_lookahead_pairs_bruteforce(spark, path):
    rows = rand_events(seed=3, n=80)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["o_id"], r["d_id"], r["k"]) for r in
                 sequence.lookahead_pairs(df, "ent", ["t", "id"], ["id", "t"], ["id", "t"], 3, order_col="t").collect())
    exp = []
    for g in groups(rows).values():
        for i in range(len(g)):
            for k in range(1, 4):
                if i + k < len(g) and g[i + k][2] > g[i][2]:
                    exp.append((g[i][0], g[i + k][0], k))
    assert got == sorted(exp)


def test_band_pairs_bruteforce(spark, path):
    rows = rand_events(seed=5, n=80)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("t").cast("double"))
    got = sorted((r["o_id"], r["d_id"], r["k"]) for r in
                 sequence.band_pairs(df, "ent", ["t", "id"], "ts", 1500.0, ["id"], ["id"]).collect())
    exp = []
    for g in groups(rows).values():
        for i in range(len(g)):
            for j in range(i + 1, len(g)):
                dt = g[j][2] - g[i][2]
                if 0 < dt <= 1500:
                    exp.append((g[i][0], g[j][0], j - i))
    assert got == sorted(exp)


def test_positions(spark, path):
    rows = rand_events(seed=11, n=50)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["rn"] for r in sequence.positions(df, "ent", ["t", "id"], "rn").collect()}
    exp = {r[0]: None for r in rows}
    for g in groups(rows).values():
        for i, r in enumerate(g):
            exp[r[0]] = i
    assert got == exp


def test_islands_null_never_equal(spark, path):
    # A,B,A -> three islands; two nulls in a row -> two islands
    stops = ["A", "A", "B", "A", None, None, "C"]
    df = spark.createDataFrame([(i, "v", i, s) for i, s in enumerate(stops)], "id long, ent string, t long, stop string")
    got = [r["island"] for r in sequence.island_ids(df, "ent", ["t"], ["stop"]).orderBy("id").collect()]
    assert got == [1, 1, 2, 3, 4, 5, 6]


def test_sessionize_gap_and_continuity(spark, path):
    t = [0, 900, 1801, 1900, 2000]
    o = ["a", "b", "c", "d", "x"]
    dd = ["b", "c", "d", "e", "y"]
    df = spark.createDataFrame([(i, "v", t[i], t[i], o[i], dd[i]) for i in range(5)],
                               "id long, ent string, t long, dep long, o string, d string")
    got = [r["s"] for r in sequence.island_ids(df, "ent", ["t"], gap=("t", 900), continuity=("o", "d"),
                                              out="s").orderBy("id").collect()]
    # 900 s gap: no break; 901 s: break; origin x != previous destination e: break
    assert got == [1, 1, 2, 2, 3]


def test_interpolate_golden(spark, path):
    vals = [None, 1.0, None, 3.0, None]
    df = spark.createDataFrame([(i, "v", i, v) for i, v in enumerate(vals)], "id long, ent string, t long, val double")
    got = [r["val"] for r in sequence.interpolate_linear(df, "ent", ["t"], "val").orderBy("id").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 3.0]


def test_interpolate_bruteforce(spark, path):
    rows = rand_events(seed=13, n=70)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["vi"] for r in sequence.interpolate_linear(df, "ent", ["t", "id"], "val", "vi").collect()}
    exp = {}
    for g in groups(rows).values():
        vals = [r[4] for r in g]
        for i, r in enumerate(g):
            if vals[i] is not None:
                exp[r[0]] = vals[i]
                continue
            p = max((j for j in range(i) if vals[j] is not None), default=None)
            n = min((j for j in range(i + 1, len(g)) if vals[j] is not None), default=None)
            if p is None:
                exp[r[0]] = None
            elif n is None:
                exp[r[0]] = vals[p]
            else:
                exp[r[0]] = vals[p] + (vals[n] - vals[p]) * ((i - p) / (n - p))
    for r in rows:
        if r[1] is None:
            exp[r[0]] = None
    assert set(got) == set(exp)
    for k in exp:
        assert (got[k] is None and exp[k] is None) or math.isclose(got[k], exp[k], rel_tol=1e-12)


def test_fill_forward_backward(spark, path):
    vals = [None, None, 2.0, None, 5.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "h long, temp double")
    got = [r["temp"] for r in sequence.fill_forward_backward(df, ["h"], ["temp"]).orderBy("h").collect()]
    assert got == [2.0, 2.0, 2.0, 2.0, 5.0, 5.0]


def test_downsample_first_non_null_per_column(spark):
    df = spark.createDataFrame([(1, "v", "2024-01-01 10:00:00", None, 1.0), (2, "v", "2024-01-01 10:00:30", "S1", 2.0),
                                (3, "v", "2024-01-01 10:02:00", "S2", None)],
                               "id long, ent string, ts string, stop string, x double").withColumn("ts", F.to_timestamp("ts"))
    r = sequence.downsample_first(df, "ent", "ts", "minute", ["stop", "x"], ["id"]).orderBy("bin_ts").collect()
    assert [(x["stop"], x["x"]) for x in r] == [("S1", 1.0), ("S2", None)]   # empty minute yields no row


def test_keep_first_and_polyline(spark):
    df = spark.createDataFrame([("s1", 2, 1.0, 1.0), ("s1", 1, 2.0, 2.0), ("s2", 5, None, 3.0)],
                               "k string, seq int, lat double, lon double")
    kf = {r["k"]: r["lat"] for r in sequence.keep_first(df, ["k"], ["seq"], ["lat"]).collect()}
    assert kf == {"s1": 2.0, "s2": None}
    pl = {r["k"]: [(p["seq"], p["lat"]) for p in r["points"]] for r in
          sequence.polyline_array(df, ["k"], "seq", "lat", "lon").collect()}
    assert pl == {"s1": [(1, 2.0), (2, 1.0)]}          # null coordinate dropped, ordered by seq


def test_interpolation_idempotent(spark, path):
    rows = rand_events(seed=21, n=40)
    df = spark.createDataFrame(rows, SCHEMA)
    once = sequence.interpolate_linear(df, "ent", ["t", "id"], "val")
    twice = sequence.interpolate_linear(once, "ent", ["t", "id"], "val")
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)
