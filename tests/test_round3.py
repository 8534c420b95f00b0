"""Exact draws, stop snapping, crowded pairs, capped and bucketed stream tables, encodings, tolerant scans."""

import datetime as dt
import math
import os
import random
import warnings

import pytest
from pyspark.sql import functions as F

from headway.operators import sequence, snap
from headway.plans import city_inputs, compare
from headway.session import scratch_path
from headway.sources import readers, sinks
from headway.streaming import feed, live_eta
from tests.test_streaming import _scored, row


# --- T10 / M9 -------------------------------------------------------------------------
def test_every_known_trip_can_be_drawn(spark):
    """Trips of a hop count are numbered without a gap, all of them, in the order of their ids' hashes."""
    n = 700
    h = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, 2).otherwise(5).alias("hops"),
                              F.col("id").cast("double").alias("tt"), F.lit(9.0).alias("dist_m"))
    h = h.unionByName(h.limit(3).withColumn("hops", F.lit(11))).unionByName(h.limit(2).withColumn("hops", F.lit(None).cast("int")))
    trips, counts = compare.known_trips(h, "hops", "tt", "dist_m", F.col("id"))
    assert {r.hops: (r["first"], r.n) for r in counts.collect()} == {2: (0, 70), 5: (70, 630)}
    places = {r.place: r.tt for r in trips.collect()}
    assert sorted(places) == list(range(n)) and sorted(places.values()) == [float(i) for i in range(n)]


# --- W13 ------------------------------------------------------------------------------
def metres(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("radius,crowded", [(300.0, 64), (300.0, 2), (60_000.0, 3), (12_000_000.0, 64)])
def test_snap_equals_a_full_search(spark, radius, crowded):
    """Also at the poles, across the date line, at cell edges, with crowded cells and stops at one place."""
    r = random.Random(int(radius) + crowded)
    spread = min(radius / 111_000 * 2, 40.0)
    centres = [(41.0, 29.0), (0.0, 180.0), (-16.5, -179.999), (89.999, 10.0), (-90.0, 0.0), (89.9, -120.0), (60.0, 0.0)]

    def near(c):
        lat = max(-90.0, min(90.0, c[0] + r.uniform(-spread, spread)))
        lon = c[1] + r.uniform(-spread, spread) / max(0.01, math.cos(math.radians(min(abs(lat), 89.0))))
        return lat, (lon + 180) % 360 - 180
    stops = [(f"s{i}", *near(centres[i % 7])) for i in range(80)]
    stops += [("s000", *stops[0][1:]), ("a_null", None, 1.0), ("z", 41.0, 29.0), ("edge", min(41.0 + radius / 111_000, 90.0), 29.0)]
    points = [(i, *near(centres[i % 7])) for i in range(150)] + [(200, None, 1.0), (201, 41.0, 29.0), (202, -90.0, 77.0), (203, 90.0, -5.0)]
    got = snap.snap_to_stops(spark.createDataFrame(points, "id long, lat double, lon double"),
                             spark.createDataFrame(stops, "stop_id string, stop_lat double, stop_lon double"), radius,
                             max_cell_stops=crowded)
    for x in got.collect():
        if x.lat is None:
            assert x.snapped_stop_id is None
            continue
        best = min((metres((x.lat, x.lon), s[1:]), s[0]) for s in stops if s[1] is not None)
        if best[0] > radius + 1e-3:
            assert x.snapped_stop_id is None and x.snap_m is None
        elif best[0] < radius - 1e-3:
            assert abs(x.snap_m - best[0]) < 1e-3
            chosen = next(s for s in stops if s[0] == x.snapped_stop_id)
            assert abs(metres((x.lat, x.lon), chosen[1:]) - best[0]) < 1e-3


def test_crowded_cells_are_searched_in_finer_grids(spark):
    stops = spark.range(400).select(F.col("id").cast("string").alias("stop_id"), (41 + F.col("id") / 1e5).alias("stop_lat"),
                                    F.lit(29.0).alias("stop_lon"))
    places = snap.stop_places(stops)
    radii = snap.search_radii(places, 500.0, 64)
    assert len(radii) > 2 and radii[-1] == 500.0
    assert snap.cell_lists(places, snap.Grid(radii[0])).agg(F.max(F.size("stops"))).first()[0] <= 64


def test_snap_keeps_rows_and_does_not_group_them(spark):
    p = spark.createDataFrame([(1, 41.0, 29.0)] * 5 + [(2, None, None)], "id long, lat double, lon double")
    s = spark.createDataFrame([("a", 41.001, 29.0)], "stop_id string, stop_lat double, stop_lon double")
    got = snap.snap_to_stops(p, s, 500.0)
    assert got.count() == 6 and got.where("snapped_stop_id = 'a'").count() == 5
    empty = snap.snap_to_stops(p, s.limit(0), 500.0)
    assert empty.count() == 6 and empty.where("snapped_stop_id IS NOT NULL").count() == 0


def test_pings_without_a_stop_take_the_nearest(spark):
    pings = spark.createDataFrame([("v", "1", None, 41.0, 29.0, 60), ("v", "1", None, 45.0, 29.0, 120), ("v", "1", "own", 41.0, 29.0, 180)],
                                  "vehicle_id string, route_id string, current_stop_id string, current_lat double, current_lon double, timestamp long")
    stops = spark.createDataFrame([("near", 41.0003, 29.0)], "stop_id string, stop_lat double, stop_lon double")
    got = [r.stop_id for r in city_inputs.pings_to_visits(pings, stops=stops).orderBy("seq").collect()]
    assert got == ["near", city_inputs.UNKNOWN_STOP, "own"]


# --- J10 --------------------------------------------------------------------------------
def test_one_vehicle_with_a_third_of_all_rows_in_one_bucket(spark, monkeypatch):
    """Its rows are cut by number: joins see pairs of stretches, and no list or window holds them."""
    monkeypatch.setattr(sequence, "PAIR_ROWS", 50)
    monkeypatch.setattr(sequence, "PAIR_STRETCH", 20)
    hot = [(i, 0, i * 0.5) for i in range(300)]
    rest = [(1000 + i, 1 + i % 60, i * 37.0) for i in range(600)]
    df = spark.createDataFrame(hot + rest, "id long, ent long, t double").repartition(4)
    p = df.where("ent = 0").withColumnsRenamed({"t": "_t"}).withColumn("_prn", F.col("id"))
    raw = sequence._pairs_of_stretches(p, ["ent"], 40.0, ["id"], ["id"])
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    met = raw.groupBy(F.floor(F.col("_ro") / 20).alias("a"), F.floor(F.col("_rd") / 20).alias("b")).count().collect()
    assert len(met) > 15 and max(r["count"] for r in met) <= 400
    got = sorted((r.o_id, r.d_id, r.k) for r in sequence.band_pairs(df, "ent", ["t", "id"], "t", 40.0, ["id"], ["id"]).collect())
    by = {}
    for i, e, t in hot + rest:
        by.setdefault(e, []).append((t, i))
    expected = [(g[a][1], g[b][1], b - a) for g in map(sorted, by.values()) for a in range(len(g)) for b in range(a + 1, len(g))
                if 0 < g[b][0] - g[a][0] <= 40.0]
    assert got == sorted(expected)


# --- R7 / K4 ----------------------------------------------------------------------------
def positions(spark, times):
    return spark.createDataFrame([(f"v{t % 3}", "r", "1.0", "2.0", str(t), "IN_TRANSIT_TO") for t in times],
                                 ", ".join(f"{c} string" for c in feed.NORMALIZED_COLS))


def times(log):
    return sorted(int(r.timestamp) for r in log.read().collect())


def test_capped_log_holds_the_newest_and_ignores_replays(spark):
    log = feed.CappedLog(spark, scratch_path(spark, "capped"), keep=10, compact_every=3)
    assert log.read().count() == 0
    seen = []
    for b in range(8):
        batch = [b * 7 + i for i in range(7)] if b != 4 else [1000 + i for i in range(12)]
        seen += batch
        assert log.append(positions(spark, batch), b)
        assert not log.append(positions(spark, [10_000 + b]), b)       # the same batch again
        assert times(log) == sorted(seen)[-10:]
    versions, deltas = log._state()
    assert versions and len(versions) <= 2 and len(deltas) <= 6       # what is merged is removed
    assert log.spark.read.parquet(f"{log.root}/v={versions[-1]}").count() == 10


def test_stream_into_the_capped_log_goes_on_after_a_restart(spark):
    landing, root, ck = (scratch_path(spark, n) for n in ("cap-landing", "cap-log", "cap-ck"))

    def land(ts):
        spark.createDataFrame([{"id": f"e{t}", "vehicle": {"vehicle": {"id": "V"}, "trip": {"route_id": "1"}, "timestamp": t,
                                                           "position": {"latitude": 1.0, "longitude": 2.0}, "current_status": "1"}}
                               for t in ts], feed.POSITION_SCHEMA).coalesce(1).write.mode("append").json(landing)
    for start in (100, 200):
        land(range(start, start + 6))
        feed.start_ingest(spark, landing, root, ck, available_now=True, keep=8).awaitTermination()
    assert times(feed.CappedLog(spark, root, 8)) == [104, 105, *range(200, 206)]


def test_repeated_positions_pass_once(spark):
    landing, root, ck = (scratch_path(spark, n) for n in ("rep-landing", "rep-log", "rep-ck"))
    entity = lambda t, lat: {"id": "e", "vehicle": {"vehicle": {"id": "V"}, "trip": {"route_id": "1"}, "timestamp": t,
                                                    "position": {"latitude": lat, "longitude": 2.0}, "current_status": "1"}}
    for batch in ([(100, 1.0), (110, 1.0), (100, 1.0)], [(110, 1.0), (100, 1.5), (120, 1.0)]):
        spark.createDataFrame([entity(*x) for x in batch], feed.POSITION_SCHEMA).coalesce(1).write.mode("append").json(landing)
        feed.start_ingest(spark, landing, root, ck, available_now=True, repeats_within="1 hour").awaitTermination()
    got = sorted((int(r.timestamp), float(r.latitude)) for r in spark.read.parquet(root).collect())
    assert got == [(100, 1.0), (100, 1.5), (110, 1.0), (120, 1.0)]


# --- K5 / R5 ----------------------------------------------------------------------------
def test_a_batch_with_one_key_writes_one_bucket(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    t = live_eta.LiveTable(spark, scratch_path(spark, "buckets"), buckets=8, compact_after=3)
    t.apply(_scored(spark, [row(60.0, t0, i, ("39", f"s{i}", "x")) for i in range(40)]), 0)
    assert len(t.layout()) == 8
    t.apply(_scored(spark, [row(70.0, t0 + dt.timedelta(seconds=5), 99, ("39", "s7", "x"))]), 1)
    assert len(t.numbers("delta", "batch_id=1", "bucket=*")) == 1
    got = {r.stop_id: r.eta_segundos for r in t.read().collect()}
    assert len(got) == 40 and got["s7"] == 70.0 and got["s8"] == 60.0


def test_buckets_are_compacted_one_by_one_and_readers_see_the_same(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    t = live_eta.LiveTable(spark, scratch_path(spark, "compact"), buckets=4, compact_after=2)
    want = {}
    for b in range(9):
        rows = [row(float(b * 10 + i), t0 + dt.timedelta(seconds=b), b * 10 + i, ("39", f"s{i}", "x")) for i in range(b % 3, 6)]
        want.update({r[1]: r[4] for r in rows})
        assert t.apply(_scored(spark, rows), b) and not t.apply(_scored(spark, rows), b)
        assert {r.stop_id: r.eta_segundos for r in t.read().collect()} == want
    layout = t.layout()
    assert any(v for v, _ in layout.values()) and all(len(v) <= 2 for v, _ in layout.values())
    assert len(t.numbers("delta", "batch_id=*", "_SUCCESS")) < 9 and t.current_version() == 8


def test_expired_keys_leave_at_compaction(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    t = live_eta.LiveTable(spark, scratch_path(spark, "expire"), retain_s=300, buckets=1, compact_after=2)
    t.apply(_scored(spark, [row(1.0, t0, 1, ("39", "old", "x")), row(2.0, t0, 2, ("39", "kept", "x"))]), 0)
    t.apply(_scored(spark, [row(3.0, t0 + dt.timedelta(seconds=301), 3, ("39", "kept", "x"))]), 1)
    (versions, deltas), = t.layout().values()
    assert versions == [1] and deltas == []
    stored = spark.read.parquet(f"{t.root}/base/bucket=0/v=1").collect()
    assert [(r.stop_id, r.event_id) for r in stored] == [("kept", 3)]


# --- S5 ---------------------------------------------------------------------------------
def test_encodings_are_judged_by_bytes_per_file(spark, tmp_path):
    files = {"a": "stop_id,name\n1,Kızılay\n2,plain\n".encode("iso-8859-9"), "b": "stop_id,name\r\n3,Şişli �\r\n".encode(),
             "c": "﻿stop_id,name\n4,Ümraniye\n\n".encode(), "d": b"stop_id,name\n5,ascii\n", "e": b"stop_id,name\n6,caf\x80\n"}
    for k, v in files.items():
        (tmp_path / f"{k}.csv").write_bytes(v)
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = {r.stop_id: (r.name, r.encoding) for r in readers.read_csv_fallback(
        spark, str(tmp_path), ["stop_id", "name"], with_encoding=True).collect()}
    assert got == {"1": ("Kızılay", "iso-8859-9"), "2": ("plain", "iso-8859-9"), "3": ("Şişli �", "utf-8"),
                   "4": ("Ümraniye", "utf-8"), "5": ("ascii", "utf-8"), "6": ("caf\x80", "iso-8859-9")}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
    only = readers.read_csv_fallback(spark, str(tmp_path / "e.csv"), ["stop_id", "name"], ["utf-8", "windows-1254"])
    assert only.first().name == "caf€"
    with pytest.raises(ValueError):
        readers.read_csv_fallback(spark, str(tmp_path), ["stop_id", "absent"])


# --- S15 / K1 ---------------------------------------------------------------------------
def test_skipped_parts_are_named_with_their_reason(spark, tmp_path):
    out = str(tmp_path / "parts")
    sinks.write_by_horizon(spark.range(30).selectExpr("id", "id % 3 + 1 AS k"), out)
    os.makedirs(f"{out}/k=4")
    with open(f"{out}/k=4/part-0.parquet", "wb") as f:
        f.write(b"PAR1" + b"junk" * 10 + b"PAR1")
    with open(f"{out}/k=4/part-1.parquet", "wb") as f:
        f.write(b"PAR1")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        good, skipped = readers.read_features_tolerant(spark, out)
    assert any("part-0.parquet" in str(w.message) for w in told)
    assert sorted((r.file.rsplit("/", 1)[1], r.part, r.reason) for r in skipped.collect()) == [
        ("part-0.parquet", "4", "no readable footer, or no rows"), ("part-1.parquet", "4", "too short")]
    assert {r.k: r["count"] for r in good.groupBy("k").count().collect()} == {1: 10, 2: 10, 3: 10}


def test_horizons_of_unequal_size_are_rebalanced(spark, tmp_path):
    """A large horizon is cut into several tasks and files, small ones share a task."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        df = spark.range(60_000).selectExpr("id", "hash(id) AS h", "CASE WHEN id % 100 < 3 THEN id % 100 + 2 ELSE 1 END AS k")
        assert "RebalancePartitions" in df.hint("rebalance", "k")._jdf.queryExecution().optimizedPlan().toString()
        sinks.write_by_horizon(df, str(tmp_path / "h"))
    finally:
        spark.conf.set(size, before)
    files = {k: len([f for f in os.listdir(tmp_path / "h" / f"k={k}") if f.endswith(".parquet")]) for k in range(1, 5)}
    assert files[1] > 2 and all(files[k] <= 2 for k in (2, 3, 4))
    assert readers.read_features(spark, str(tmp_path / "h")).count() == 60_000


# --- T7 / T9 ----------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 77, 500, 10_000])
def test_row_cap_is_exact_and_repeatable(spark, n):
    from headway.operators import splits
    df = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"))
    got = sorted((str(r.a), r.b) for r in splits.row_cap(df, ["a", "b"], n).collect())
    again = sorted((str(r.a), r.b) for r in splits.row_cap(df.repartition(3), ["a", "b"], n).collect())
    assert len(got) == min(n, 500) and got == again


def test_smaller_samples_are_parts_of_larger_ones(spark):
    from headway.operators import splits
    df = spark.range(3000).withColumn("k", F.col("id") % 3)
    some, more = ({r.id for r in splits.stratified_sample(df, "k", ["id"], f).collect()} for f in (0.05, 0.2))
    assert some < more and 90 < len(some) < 210 and 480 < len(more) < 720


def test_entries_without_the_optional_packages():
    """Only the operators that need a missing package are left out."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['tokenizers'] = None\nimport __spark_entry__ as e\n"
            "q = e.queries(); assert 'route_requests' in q and not any(n.startswith('op') and n[2].isdigit() for n in q), list(q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
