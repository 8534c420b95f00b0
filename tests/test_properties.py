"""Property tests (hypothesis): pairing operators against a brute-force model on random
sequences, with random chunk sizes so the hot-entity path and its halos are exercised."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from headway.operators import sequence

ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 400)), min_size=1, max_size=40)


def brute(rows, k_max=None, max_dt=None):
    g = {}
    for i, (e, t) in enumerate(rows):
        if e is not None:
            g.setdefault(e, []).append((t, i))
    out = []
    for seq in g.values():
        seq.sort()
        for a in range(len(seq)):
            for b in range(a + 1, len(seq)):
                k = b - a
                dt = seq[b][0] - seq[a][0]
                if k_max is not None and (k > k_max or dt <= 0):
                    continue
                if max_dt is not None and not (0 < dt <= max_dt):
                    continue
                out.append((seq[a][1], seq[b][1], k))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, chunk=st.integers(2, 6), k_max=st.integers(1, 4))
def test_lookahead_matches_brute_force(spark, rows, chunk, k_max):
    old = sequence.CHUNK_ROWS
    sequence.CHUNK_ROWS = chunk
    try:
        df = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(rows)], "id long, ent string, t long")
        got = sorted((r["o_id"], r["d_id"], r["k"]) for r in sequence.lookahead_pairs(
            df, "ent", ["t", "id"], ["id", "t"], ["id", "t"], k_max, order_col="t").collect())
        assert got == brute(rows, k_max=k_max)
    finally:
        sequence.CHUNK_ROWS = old


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, max_dt=st.integers(1, 200))
def test_band_pairs_match_brute_force(spark, rows, max_dt):
    df = spark.createDataFrame([(i, e, t, float(t)) for i, (e, t) in enumerate(rows)],
                               "id long, ent string, t long, ts double")
    got = sorted((r["o_id"], r["d_id"], r["k"]) for r in sequence.band_pairs(
        df, "ent", ["t", "id"], "ts", float(max_dt), ["id"], ["id"]).collect())
    assert got == brute(rows, max_dt=max_dt)


VALS = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 300),
                          st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=VALS, chunk=st.integers(1, 5))
def test_islands_and_interpolation_across_chunks(spark, rows, chunk):
    old = sequence.CHUNK_ROWS
    sequence.CHUNK_ROWS = chunk
    try:
        df = spark.createDataFrame([(i, e, t, v, None if v is None else float(v)) for i, (e, t, v) in enumerate(rows)],
                                   "id long, ent string, t long, v int, x double")
        isl = {r["id"]: r["isl"] for r in sequence.island_ids(df, "ent", ["t", "id"], ["v"], out="isl").collect()}
        itp = {r["id"]: r["xi"] for r in sequence.interpolate_linear(df, "ent", ["t", "id"], "x", "xi").collect()}
    finally:
        sequence.CHUNK_ROWS = old
    g = {}
    for i, (e, t, v) in enumerate(rows):
        g.setdefault(e, []).append((t, i, v))
    for seq in g.values():
        seq.sort()
        n = 0
        for j, (_, i, v) in enumerate(seq):
            if j == 0 or v is None or seq[j - 1][2] is None or v != seq[j - 1][2]:
                n += 1                                     # null never equals null (N4)
            assert isl[i] == n
            vals = [s[2] for s in seq]
            if v is not None:
                assert itp[i] == float(v)
                continue
            p = max((q for q in range(j) if vals[q] is not None), default=None)
            nx = min((q for q in range(j + 1, len(seq)) if vals[q] is not None), default=None)
            exp = None if p is None else float(vals[p]) if nx is None else \
                vals[p] + (vals[nx] - vals[p]) * ((j - p) / (nx - p))
            assert (itp[i] is None and exp is None) or abs(itp[i] - exp) < 1e-9
