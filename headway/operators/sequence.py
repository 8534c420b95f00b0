"""Ordered per-entity sequence operators.

Every operator here works on "an entity ordered by some columns" (a trip ordered by
stop sequence, a vehicle or user ordered by time). A plain
``Window.partitionBy(entity)`` would put a whole entity into one task, which fails when
one entity holds a large share of all rows. The skew-safe path used by default:

1. ``positions``: the position ``_rn`` of each row inside its entity is computed
   without a per-entity window. One range shuffle by (entity, order) cuts the rows into
   even ranges, written to the shared folder so that the ranges stay fixed. A range
   holds a stretch of an entity; its rows are counted per (entity, range), an exclusive
   prefix sum over those counts (at most a row per entity and range, so a hot entity has
   at most as many as there are partitions) gives each stretch its base, and
   ``row_number`` inside ``(entity, range)`` finishes it. Any order type is cut evenly.
2. ``Seq.run``: rows of hot entities are cut into chunks of ``chunk_rows`` consecutive positions.
   A row that is within ``back``/``fwd`` positions of a chunk edge is copied into the
   neighbouring chunk as a *halo* row, so bounded lags/leads over
   ``partitionBy(entity, chunk)`` are exact. Halo rows are dropped afterwards.
3. Running sums and carries (island ids, forward fill) combine an in-chunk window
   with an exclusive prefix over per-chunk totals.

Only hot entities take that path: entities with more than ``CHUNK_ROWS`` rows are
found by one small statistics job (row counts of ``HOT_CELLS`` hash cells, then a count per entity
in the cells that hold more) and kept as a table; a join with it sends their rows to the chunked branch, while every other entity uses one
``partitionBy(entity)`` window, i.e. a single shuffle. Nothing but "is there any" reaches
the driver. ``skew_safe=False`` skips the statistics job.

Unbounded pairs (``band_pairs``) take positions first. An entity of few rows gets its
partners from a time frame in the same exchange; a larger one is cut into stretches of
even numbers of rows, which meet in pairs when their time spans are near enough. So no task
and no list grows with one entity's density, and ``k`` is the difference of the positions,
whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_null
from ..session import materialize

SKEW_SAFE = True            # default for every operator in this module
CHUNK_ROWS = 1 << 20        # rows per (entity, chunk) window partition
HOT_CELLS = 1 << 16         # hash cells whose row counts rule out hot entities
PAIR_ROWS = 4096            # rows of an entity whose pairs come from one window
PAIR_STRETCH = 1024         # rows of a stretch of a larger entity


def _as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def _ord(cols) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in cols]


def hot_entities(df: DataFrame, entity, min_rows: int | None = None) -> DataFrame:
    """Entities (a null key counts as one) with more than ``min_rows`` rows, from one
    partial aggregation. At most ``rows / min_rows`` keys exist."""
    entity = _as_list(entity)
    min_rows = CHUNK_ROWS if min_rows is None else min_rows
    return (df.groupBy(*entity).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > min_rows).select(*entity))


def route_entities(df: DataFrame, entity, min_rows: int | None = None) -> DataFrame | None:
    """The hot entities as a table in the shared folder, or None when there is none (the
    usual case: one window per entity, a single shuffle). At most ``rows / min_rows`` keys
    exist; Spark broadcasts the table when its size allows and else splits the skew.

    An entity lies in one hash cell, so it is not hot if its cell has few rows. The cells are counted
    first (at most ``HOT_CELLS`` rows a task are shuffled, however many entities there are); entities are
    counted only in the cells with more than ``min_rows`` rows, if any."""
    entity = _as_list(entity)
    min_rows = CHUNK_ROWS if min_rows is None else min_rows
    cell = F.pmod(F.xxhash64(*entity), F.lit(HOT_CELLS)).alias("_cell")
    keys = df.select(*entity, cell)
    full = materialize(keys.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows)
                       .select("_cell"), "cells")
    if not full.limit(1).count():
        return None
    few = hot_entities(keys.join(F.broadcast(full), "_cell", "left_semi"), entity, min_rows)
    hot = materialize(few.withColumn("_hot", F.lit(True)), "hot")
    return hot if hot.limit(1).count() else None


def split_hot(df: DataFrame, entity, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cold rows, hot rows) given ``route_entities``' table; null keys match null keys."""
    entity = _as_list(entity)
    h = hot.withColumnsRenamed({c: f"_h_{c}" for c in entity})
    on = F.lit(True)
    for c in entity:
        on = on & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    d = df.join(h, on, "left").drop(*[f"_h_{c}" for c in entity])
    return d.where(F.col("_hot").isNull()).drop("_hot"), d.where("_hot").drop("_hot")


def _range_positions(df: DataFrame, entity, order, rn: str) -> DataFrame:
    """Positions by ranges of (entity, order); keeps the range number in ``_blk``."""
    keys = [F.col(c).asc_nulls_last() for c in entity] + _ord(order)
    d = materialize(df.repartitionByRange(*keys).withColumn("_blk", F.spark_partition_id().cast("long")), "ranges")
    cnt = d.groupBy(*entity, "_blk").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*entity).orderBy("_blk")
    cnt = cnt.select(*entity, "_blk", (F.sum("_bn").over(wb) - F.col("_bn")).alias("_base"))
    # Left equi-join: null entities find no base and keep a null position.
    d = d.join(cnt, [*entity, "_blk"], "left")
    w = Window.partitionBy(*entity, "_blk").orderBy(*_ord(order))
    return d.withColumn(rn, F.col("_base") + F.row_number().over(w) - 1).drop("_base")


def positions(df: DataFrame, entity, order, rn: str = "_rn", skew_safe: bool | None = None,
              chunk_rows: int | None = None) -> DataFrame:
    """Add ``rn``: 0-based position of the row within its entity under ``order``
    (ascending, nulls last). Rows with a null entity key get a null position (they
    never take part in a sequence, N5/N6).

    Skew-safe: cold entities use one ``row_number`` window per entity; rows of hot
    entities (and null keys) use block counts + prefix sums + ``row_number`` inside
    ``(entity, block)``, so no task holds a whole hot entity."""
    entity, order = _as_list(entity), _as_list(order)
    skew_safe = SKEW_SAFE if skew_safe is None else skew_safe
    w = Window.partitionBy(*entity).orderBy(*_ord(order))

    def plain(x):
        return x.withColumn(rn, F.when(~any_null(entity), F.row_number().over(w) - 1))

    if not skew_safe:
        return plain(df)
    hot_keys = route_entities(df, entity, chunk_rows)
    if hot_keys is None:
        return plain(df)
    cold, hot = split_hot(df, entity, hot_keys)
    return plain(cold).unionByName(_range_positions(hot, entity, order, rn).drop("_blk"))


class Branch:
    """Window helpers for one branch of a ``Seq`` (single window per entity, or chunked)."""

    def __init__(self, entity: list[str], chunked: bool):
        self.entity, self.chunked = entity, chunked

    def null_if_no_entity(self, c: Column) -> Column:
        return F.when(~any_null(self.entity), c)

    def running_sum(self, d: DataFrame, w: Window, value: str, out: str, inclusive: bool = True) -> DataFrame:
        """``out`` = running sum of ``value`` over the entity in order (non-halo rows).
        Chunked: in-chunk window + exclusive prefix of per-chunk totals."""
        v = F.when(~F.col("_halo"), F.col(value)).otherwise(F.lit(0))
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        d = d.withColumn(out, F.coalesce(F.sum(v).over(frame), F.lit(0)))
        if not self.chunked:
            return d
        tot = (d.where(~F.col("_halo")).groupBy(*self.entity, "_ck")
               .agg(F.sum(F.col(value)).alias("_ct")))
        wc = Window.partitionBy(*self.entity).orderBy("_ck")
        tot = tot.select(*self.entity, "_ck",
                         F.coalesce(F.sum("_ct").over(wc.rowsBetween(Window.unboundedPreceding, -1)),
                                    F.lit(0)).alias("_coff"))
        d = d.join(tot, [*self.entity, "_ck"], "left")
        return d.withColumn(out, F.col(out) + F.coalesce(F.col("_coff"), F.lit(0))).drop("_coff")

    def carry_last(self, d: DataFrame, w: Window, value: str, out_val: str, out_rn: str,
                   reverse: bool = False) -> DataFrame:
        """Last non-null ``value`` at or before each row (``reverse``: first at or after),
        with the position it came from. Exact across chunks."""
        vv = F.when(~F.col("_halo"), F.col(value))
        rr = F.when(~F.col("_halo") & F.col(value).isNotNull(), F.col("_rn"))
        if reverse:
            frame = w.rowsBetween(0, Window.unboundedFollowing)
            d = d.withColumn(out_val, F.first(vv, ignorenulls=True).over(frame)) \
                 .withColumn(out_rn, F.first(rr, ignorenulls=True).over(frame))
        else:
            frame = w.rowsBetween(Window.unboundedPreceding, 0)
            d = d.withColumn(out_val, F.last(vv, ignorenulls=True).over(frame)) \
                 .withColumn(out_rn, F.last(rr, ignorenulls=True).over(frame))
        if not self.chunked:
            return d
        core = d.where(~F.col("_halo") & F.col(value).isNotNull())
        agg = F.min_by if reverse else F.max_by
        per = core.groupBy(*self.entity, "_ck").agg(
            agg(F.struct(F.col(value).alias("v"), F.col("_rn").alias("r")), F.col("_rn")).alias("_s"))
        wc = Window.partitionBy(*self.entity).orderBy("_ck")
        # chunks with no non-null value still need a carry: build it from the chunk list
        chunks = d.where(~F.col("_halo")).select(*self.entity, "_ck").distinct()
        allc = chunks.join(per.select(*self.entity, "_ck", "_s"), [*self.entity, "_ck"], "left")
        if reverse:
            allc = allc.withColumn("_carry", F.first("_s", ignorenulls=True).over(
                wc.rowsBetween(1, Window.unboundedFollowing)))
        else:
            allc = allc.withColumn("_carry", F.last("_s", ignorenulls=True).over(
                wc.rowsBetween(Window.unboundedPreceding, -1)))
        d = d.join(allc.select(*self.entity, "_ck", "_carry"), [*self.entity, "_ck"], "left")
        return (d.withColumn(out_val, F.coalesce(F.col(out_val), F.col("_carry.v")))
                 .withColumn(out_rn, F.coalesce(F.col(out_rn), F.col("_carry.r"))).drop("_carry"))


class Seq:
    """An entity-ordered view of a DataFrame with exact bounded-offset windows.

    ``run(fn, back, fwd)`` applies ``fn(rows, window, branch)`` to
    * the cold branch: entities with at most ``chunk_rows`` rows, one
      ``partitionBy(entity)`` window (a single shuffle), and
    * the hot branch: rows of larger entities and of null keys, cut into
      ``(entity, chunk)`` partitions with ``back``/``fwd`` halo rows,
    and returns the union with halo rows and helper columns removed. In both branches
    ``_rn`` is the row's position in its entity and the window orders by it, so
    ``lag(c, j)`` (j <= back) and ``lead(c, j)`` (j <= fwd) are exact.

    ``counted``: a frame with at least as many rows of each entity, cheaper to make than ``df`` (its source,
    say), in which to look for hot entities.
    """

    def __init__(self, df: DataFrame, entity, order, skew_safe: bool | None = None,
                 chunk_rows: int | None = None, counted: DataFrame | None = None):
        self.counted = df if counted is None else counted
        self.entity = _as_list(entity)
        self.order = _as_list(order)
        self.skew_safe = SKEW_SAFE if skew_safe is None else skew_safe
        self.chunk_rows = CHUNK_ROWS if chunk_rows is None else chunk_rows
        self.df = df

    def _plain(self, df: DataFrame) -> tuple[DataFrame, Window]:
        w = Window.partitionBy(*self.entity).orderBy(*_ord(self.order))
        d = (df.withColumn("_rn", F.when(~any_null(self.entity), F.row_number().over(w) - 1))
               .withColumn("_ck", F.lit(0).cast("long")).withColumn("_halo", F.lit(False)))
        return d, w

    def _chunked(self, df: DataFrame, back: int, fwd: int) -> tuple[DataFrame, Window]:
        size = max(self.chunk_rows, back, fwd, 1)   # a chunk always covers its halo
        d = _range_positions(df, self.entity, self.order, "_rn")
        rn = F.col("_rn")
        # null positions (null entity): spread by range, results are nulled anyway
        ck = F.coalesce(F.floor(rn / size), -1 - F.col("_blk"))
        pos = F.pmod(rn, F.lit(size))
        elems = [F.struct(ck.alias("ck"), F.lit(False).alias("halo"))]
        if back:
            elems.append(F.when(pos >= size - back, F.struct((ck + 1).alias("ck"), F.lit(True).alias("halo"))))
        if fwd:
            elems.append(F.when(pos < fwd, F.struct((ck - 1).alias("ck"), F.lit(True).alias("halo"))))
        d = d.withColumn("_cp", F.explode(F.filter(F.array(*elems), lambda x: x.isNotNull())))
        d = d.withColumn("_ck", F.col("_cp.ck")).withColumn("_halo", F.col("_cp.halo")).drop("_cp", "_blk")
        w = Window.partitionBy(*self.entity, "_ck").orderBy("_rn")
        return d, w

    def run(self, fn, back: int = 0, fwd: int = 0, keep_rn: bool = False) -> DataFrame:
        keys = route_entities(self.counted, self.entity, self.chunk_rows) if self.skew_safe else None
        if keys is None:
            d, w = self._plain(self.df)
            return self.finish(fn(d, w, Branch(self.entity, False)), keep_rn)
        cold, hot = split_hot(self.df, self.entity, keys)
        dc, wc = self._plain(cold)
        dh, wh = self._chunked(hot, back, fwd)
        a = self.finish(fn(dc, wc, Branch(self.entity, False)), keep_rn)
        b = self.finish(fn(dh, wh, Branch(self.entity, True)), keep_rn)
        return a.unionByName(b)

    @staticmethod
    def finish(d: DataFrame, keep_rn: bool = False) -> DataFrame:
        d = d.where(~F.col("_halo"))
        drop = ["_ck", "_halo"] + ([] if keep_rn else ["_rn"])
        return d.drop(*[c for c in drop if c in d.columns])


# ---------------------------------------------------------------------------
# Previous point, leg speed, speed lags
# ---------------------------------------------------------------------------
def speed_lags(df: DataFrame, entity, order, lat: str, lon: str, t_seconds: str, n: int = 3,
               float32_coords: bool = False, skew_safe: bool | None = None,
               keep_leg: bool = False) -> DataFrame:
    """Leg speed = haversine(previous point, point) / (t - t_prev) (null when the time
    difference is 0 or a value is missing), then ``vel_lag_1..n`` = speed of the
    previous 1..n legs with missing -> 0.0. A null entity gets zeros (N5)."""
    fn = speed_lag_step(lat, lon, t_seconds, n, float32_coords, keep_leg)
    return Seq(df, entity, order, skew_safe).run(fn, back=n + 1)


def speed_lag_step(lat: str, lon: str, t_seconds: str, n: int = 3, float32_coords: bool = False,
                   keep_leg: bool = False):
    """The W1/W2 computation as a frame step, so it can share one frame (one shuffle)
    with other window steps such as the lookahead."""
    from ..functions.geo import haversine_m

    def fn(d, w, b):
        prev_lat, prev_lon, prev_t = (F.lag(F.col(c), 1).over(w) for c in (lat, lon, t_seconds))
        dist = haversine_m(prev_lat, prev_lon, F.col(lat), F.col(lon), float32_coords)
        dt = F.col(t_seconds).cast("double") - prev_t.cast("double")
        vel = F.try_divide(dist, dt)
        d = d.withColumn("_vel", b.null_if_no_entity(F.when(~F.isnan(vel), vel)))
        if keep_leg:
            d = d.withColumn("leg_m", b.null_if_no_entity(dist)).withColumn("leg_s", b.null_if_no_entity(dt))
        for j in range(1, n + 1):
            d = d.withColumn(f"vel_lag_{j}", F.coalesce(F.lag("_vel", j).over(w), F.lit(0.0)))
        return d.drop("_vel")
    return fn


def row_index(df: DataFrame, entity, order, out: str = "row_in_entity", skew_safe: bool | None = None) -> DataFrame:
    """0-based row number within the entity (cumcount)."""
    return positions(df, entity, order, out, skew_safe=skew_safe)


def previous_values(df: DataFrame, entity, order, cols, n: int = 1, skew_safe: bool | None = None) -> DataFrame:
    """``prev_<c>`` = value of the row ``n`` places earlier in the entity."""

    def fn(d, w, b):
        for c in _as_list(cols):
            d = d.withColumn(f"prev_{c}", b.null_if_no_entity(F.lag(F.col(c), n).over(w)))
        return d

    return Seq(df, entity, order, skew_safe).run(fn, back=n)


# ---------------------------------------------------------------------------
# Origin-destination pairs
# ---------------------------------------------------------------------------
def lookahead_pairs(df: DataFrame, entity, order, origin_cols, dest_cols, k_max: int,
                    max_order_gap: tuple[str, int] | None = None, order_col: str | None = None,
                    leg_input: bool = False, skew_safe: bool | None = None, prepare=None,
                    prepare_back: int = 0) -> DataFrame:
    """W4 bounded: pair each row with the rows 1..k_max places later in its entity.

    Output: ``o_<c>`` for origin columns, ``d_<c>`` for destination columns, ``k``.
    ``order_col``: destination must be strictly later in it (F1, null never pairs).
    ``max_order_gap=(col, K)``: also require ``d.col - o.col <= K`` (train rule).
    ``leg_input``: rows are legs and ``dest_cols`` name the leg's destination columns, so
    k pairs leg i's origin with leg i+k's destination (k=1 is two physical hops, as the
    leg-log feeds label them); the pairing itself is the same.
    Halo of k_max rows makes this exact without a per-entity window.
    ``prepare(d, w, branch)`` (e.g. ``speed_lag_step``) runs first in the same frame
    (needs ``prepare_back`` rows of look-back), so both share one shuffle.
    """
    dcols = _as_list(dest_cols)
    dstruct = F.struct(*[F.col(c).alias(c) for c in dcols])
    ent = _as_list(entity)

    def fn(d, w, b):
        if prepare is not None:
            d = prepare(d, w, b)
        cands = F.array(*[F.struct(F.lit(j).alias("k"), F.lead(dstruct, j).over(w).alias("d"))
                          for j in range(1, k_max + 1)])
        return d.withColumn("_c", F.when(~any_null(ent), cands))

    d = Seq(df, entity, order, skew_safe).run(fn, back=prepare_back, fwd=k_max).where(F.col("_c").isNotNull())
    sel = [*(F.col(c).alias(f"o_{c}") for c in _as_list(origin_cols))]
    d = d.select(*sel, F.explode(F.col("_c")).alias("_p"))
    d = d.where(F.col("_p.d").isNotNull())
    out = d.select(*[F.col(f"o_{c}") for c in _as_list(origin_cols)],
                   *[F.col(f"_p.d.{c}").alias(f"d_{c}") for c in dcols],
                   F.col("_p.k").alias("k"))
    if order_col is not None:
        out = out.where(F.col(f"d_{order_col}") > F.col(f"o_{order_col}"))
    if max_order_gap is not None:
        gc, gk = max_order_gap
        out = out.where((F.col(f"d_{gc}") - F.col(f"o_{gc}")) <= gk)
    return out


def band_pairs(df: DataFrame, entity, order, t_seconds: str, max_dt: float, origin_cols, dest_cols,
               order_col: str | None = None, skew_safe: bool | None = None, rn_col: str | None = None,
               same_time: bool = False) -> DataFrame:
    """W4 unbounded / J10: every (origin, destination) of an entity with destination
    later in the sequence and ``0 < t_d - t_o <= max_dt``, labelled ``k`` = position gap.

    This is exactly the set the unbounded lookahead keeps after the travel-time filter,
    without enumerating all pairs of an entity. ``rn_col`` names a position column that exists
    already. ``same_time`` also keeps ``t_d = t_o`` (leg rows, whose travel time ends at an
    arrival). Entities of at most ``PAIR_ROWS`` rows take one window (``_pairs_in_window``); the
    rows of larger ones are cut into stretches that meet in pairs (``_pairs_of_stretches``).
    """
    entity, order = _as_list(entity), _as_list(order)
    ocols, dcols = _as_list(origin_cols), _as_list(dest_cols)
    skew_safe = SKEW_SAFE if skew_safe is None else skew_safe

    def timed(d):
        return (d.where(~any_null(entity) & F.col(t_seconds).isNotNull()).withColumn("_t", F.col(t_seconds).cast("double"))
                 .withColumn("_tu", F.round(F.col("_t") * 1e6).cast("long")))

    def few(d):
        w = Window.partitionBy(*entity).orderBy(*_ord(order))
        p = d.withColumn("_prn", F.col(rn_col) if rn_col else F.row_number().over(w) - 1)
        return _pairs_in_window(timed(p), entity, max_dt, ocols, dcols)

    def many(d):
        p = d.withColumn("_prn", F.col(rn_col)) if rn_col else positions(d, entity, order, "_prn")
        return _pairs_of_stretches(timed(p), entity, max_dt, ocols, dcols)

    hot = route_entities(df, entity, PAIR_ROWS) if skew_safe else None
    if hot is None:
        p = few(df)
    else:
        cold, crowded = split_hot(df, entity, hot)
        p = few(cold).unionByName(many(crowded))
    dt = F.col("_td") - F.col("_to")
    apart = dt >= 0 if same_time else dt > 0
    out = p.where((F.col("_rd") > F.col("_ro")) & apart & (dt <= float(max_dt)))
    out = out.select(*entity, *[f"o_{c}" for c in ocols], *[f"d_{c}" for c in dcols],
                     (F.col("_rd") - F.col("_ro")).cast("int").alias("k"))
    if order_col is not None:
        out = out.where(F.col(f"d_{order_col}") > F.col(f"o_{order_col}"))
    return out


def _pairs_in_window(p: DataFrame, entity, max_dt: float, ocols, dcols) -> DataFrame:
    """Candidate pairs of small entities: the rows within ``max_dt`` after a row, in the exchange that
    numbered them. A list holds at most ``PAIR_ROWS`` rows."""
    dest = F.struct(F.col("_prn").alias("_rd"), F.col("_t").alias("_td"), *[F.col(c).alias(f"d_{c}") for c in dcols])
    # integer-microsecond range frame (one extra microsecond; the exact test follows)
    frame = Window.partitionBy(*entity).orderBy("_tu").rangeBetween(0, int(round(max_dt * 1e6)) + 1)
    p = p.withColumn("_cand", F.collect_list(dest).over(frame))
    return p.select(*entity, F.col("_prn").alias("_ro"), F.col("_t").alias("_to"),
                    *[F.col(c).alias(f"o_{c}") for c in ocols], F.inline("_cand"))


def _pairs_of_stretches(p: DataFrame, entity, max_dt: float, ocols, dcols) -> DataFrame:
    """Candidate pairs of crowded entities. Rows are cut into stretches of ``PAIR_STRETCH`` positions, so
    stretches are even however dense a time is. Of each stretch its time span is known (one row); two
    stretches meet when the spans are within ``max_dt``, found by the time buckets they touch. Rows
    follow their stretch, and the join is on the pair of stretches: a group holds at most
    ``PAIR_STRETCH`` rows of either side, and no list is collected."""
    p = materialize(p.withColumn("_st", F.floor(F.col("_prn") / PAIR_STRETCH)).select(
        *entity, "_st", "_prn", "_t", *[c for c in dict.fromkeys([*ocols, *dcols]) if c not in entity]), "stretches")
    spans = p.groupBy(*entity, "_st").agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
    bucket = lambda t: F.floor(t / F.lit(float(max_dt)))
    touch = lambda lo, hi: F.explode(F.sequence(bucket(lo), bucket(hi)))
    first = spans.select(*entity, F.col("_st").alias("_so"), F.col("_t0").alias("_a0"), F.col("_t1").alias("_a1"),
                         touch(F.col("_t0"), F.col("_t1") + max_dt).alias("_bk"))
    then = spans.select(*entity, F.col("_st").alias("_sd"), F.col("_t0").alias("_b0"), F.col("_t1").alias("_b1"),
                        touch(F.col("_t0"), F.col("_t1")).alias("_bk"))
    near = ((F.col("_sd") >= F.col("_so")) & (F.col("_b1") >= F.col("_a0")) & (F.col("_b0") <= F.col("_a1") + max_dt)
            # of the buckets that both touch, the first one counts
            & (F.col("_bk") == F.greatest(bucket(F.col("_a0")), bucket(F.col("_b0")))))
    meet = materialize(first.join(then, [*entity, "_bk"]).where(near).select(*entity, "_so", "_sd"), "meetings")
    origins = p.select(*entity, F.col("_st").alias("_so"), F.col("_prn").alias("_ro"), F.col("_t").alias("_to"),
                       *[F.col(c).alias(f"o_{c}") for c in ocols]).join(meet, [*entity, "_so"])
    dests = p.select(*entity, F.col("_st").alias("_sd"), F.col("_prn").alias("_rd"), F.col("_t").alias("_td"),
                     *[F.col(c).alias(f"d_{c}") for c in dcols]).join(meet, [*entity, "_sd"])
    return origins.join(dests, [*entity, "_so", "_sd"]).drop("_so", "_sd")


# ---------------------------------------------------------------------------
# Islands and sessions
# ---------------------------------------------------------------------------
def island_ids(df: DataFrame, entity, order, change_cols=(), gap: tuple[str, float] | None = None,
               continuity: tuple[str, str] | None = None, out: str = "island",
               skew_safe: bool | None = None) -> DataFrame:
    """Number consecutive runs within an entity.

    A new island starts at the first row, when any ``change_cols`` differs from the
    previous row (null never equals null, N4), when ``gap=(t_col, seconds)`` is
    exceeded between the previous row's end time and this row's start time
    (``t_col`` may be a pair ``(start, prev_end)`` of names), or when
    ``continuity=(origin, destination)`` breaks (origin != previous destination).
    """

    def fn(d, w, b):
        flag = F.lag(F.lit(1), 1).over(w).isNull()
        for c in _as_list(change_cols):
            flag = flag | F.coalesce(F.col(c) != F.lag(F.col(c), 1).over(w), F.lit(True))
        if gap is not None:
            tcol, secs = gap
            start, prev_end = (tcol, tcol) if isinstance(tcol, str) else tcol
            g = F.col(start).cast("double") - F.lag(F.col(prev_end), 1).over(w).cast("double")
            flag = flag | F.coalesce(g > secs, F.lit(False))
        if continuity is not None:
            oc, dc = continuity
            flag = flag | F.coalesce(F.col(oc) != F.lag(F.col(dc), 1).over(w), F.lit(True))
        d = b.running_sum(d.withColumn("_flag", flag.cast("long")), w, "_flag", out)
        return d.withColumn(out, b.null_if_no_entity(F.col(out))).drop("_flag")

    return Seq(df, entity, order, skew_safe).run(fn, back=1)


def collapse_islands(df: DataFrame, entity, order, change_cols, start: str, end: str,
                     first_cols=(), skew_safe: bool | None = None) -> DataFrame:
    """A3 after W6: one row per island with min start, max end, the first row's
    ``first_cols`` and the row count. Partial aggregation, no per-island window."""
    entity, order = _as_list(entity), _as_list(order)
    d = island_ids(df, entity, order, change_cols, out="island", skew_safe=skew_safe)
    okey = F.struct(*[F.col(c) for c in order])
    firsts = [F.min_by(F.col(c), okey).alias(c) for c in _as_list(first_cols)]
    return d.groupBy(*entity, "island").agg(F.min(start).alias(start), F.max(end).alias(end), *firsts,
                                           F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------------------
# W8 / W9
# ---------------------------------------------------------------------------
def next_leg(df: DataFrame, entity, order, cols, prefix: str = "next_", keep_last: bool = False,
             skew_safe: bool | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Attach the next row's ``cols`` (lead 1); the last row of an entity is
    dropped unless ``keep_last``. ``counted``: see ``Seq``."""

    def fn(d, w, b):
        for c in _as_list(cols):
            d = d.withColumn(f"{prefix}{c}", b.null_if_no_entity(F.lead(F.col(c), 1).over(w)))
        return d.withColumn("_has_next", b.null_if_no_entity(F.lead(F.lit(1), 1).over(w)).isNotNull())

    d = Seq(df, entity, order, skew_safe, counted=counted).run(fn, fwd=1)
    if not keep_last:
        d = d.where(F.col("_has_next"))
    return d.drop("_has_next")


def interpolate_linear(df: DataFrame, entity, order, col: str, out: str | None = None,
                       skew_safe: bool | None = None) -> DataFrame:
    """Fill nulls of ``col`` by linear interpolation *by position* inside the
    entity. Leading nulls stay null; trailing nulls take the last value."""
    out = out or col

    def fn(d, w, b):
        d = b.carry_last(d, w, col, "_pv", "_pr")
        d = b.carry_last(d, w, col, "_nv", "_nr", reverse=True)
        frac = (F.col("_rn") - F.col("_pr")) / (F.col("_nr") - F.col("_pr"))
        interp = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * frac
        val = F.coalesce(F.col(col).cast("double"),
                         F.when(F.col("_nv").isNull(), F.col("_pv")).otherwise(interp))
        return d.withColumn(out, b.null_if_no_entity(val)).drop("_pv", "_pr", "_nv", "_nr")

    return Seq(df, entity, order, skew_safe).run(fn)


def fill_forward_backward(df: DataFrame, order, cols, skew_safe: bool | None = None) -> DataFrame:
    """W10 on an ordered (small) series without an entity: forward fill then back fill
    each column. Exact two-pass carry across chunks, no single-partition window over
    the data itself."""

    def fn(d, w, b):
        for c in _as_list(cols):
            d = b.carry_last(d, w, c, "_fv", "_fr")
            d = b.carry_last(d, w, c, "_bv", "_br", reverse=True)
            d = d.withColumn(c, F.coalesce(F.col(c), F.col("_fv"), F.col("_bv"))).drop("_fv", "_fr", "_bv", "_br")
        return d

    return Seq(df.withColumn("_all", F.lit(0)), ["_all"], order, skew_safe).run(fn).drop("_all")


# ---------------------------------------------------------------------------
# Aggregations over sequences
# ---------------------------------------------------------------------------
def downsample_first(df: DataFrame, keys, ts: str, unit: str, cols, tiebreak=()) -> DataFrame:
    """A4: per key and ``date_trunc(unit, ts)`` bin, the first **non-null** value of each
    column by time (each column independently). Partial aggregation, no window."""
    keys = _as_list(keys)
    okey = F.struct(F.col(ts), *[F.col(c) for c in _as_list(tiebreak)])
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(c) for c in _as_list(cols)]
    return (df.withColumn("bin_ts", F.date_trunc(unit, F.col(ts).cast("timestamp")))
              .groupBy(*keys, "bin_ts").agg(*aggs))


def keep_first(df: DataFrame, keys, order, cols=None) -> DataFrame:
    """One row per key, the first by ``order`` (explicit, deterministic; unlike
    ``dropDuplicates``). Implemented as ``min_by`` so hot keys are pre-aggregated."""
    keys, order = _as_list(keys), _as_list(order)
    cols = [c for c in (cols or df.columns) if c not in keys]
    okey = F.struct(*[F.col(c) for c in order])
    row = F.min_by(F.struct(*[F.col(c) for c in cols]), okey).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def centroid(df: DataFrame, keys, lat: str, lon: str) -> DataFrame:
    """Mean coordinate per key."""
    return df.groupBy(*_as_list(keys)).agg(F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))


def ordered_points(df: DataFrame, keys, order, cols, skew_safe: bool | None = None) -> DataFrame:
    """A14 as a table: (key, point_seq, cols...) in order. This is the scalable form of
    a polyline; ``polyline_array`` builds the list for bounded shapes."""
    d = positions(df, keys, order, "point_seq", skew_safe=skew_safe)
    return d.select(*_as_list(keys), "point_seq", *_as_list(cols))


def polyline_array(df: DataFrame, keys, order_col: str, lat: str, lon: str) -> DataFrame:
    """A14 list form for bounded shapes (GTFS shapes hold at most a few thousand points):
    ``sort_array(collect_list(struct(seq, lat, lon)))``; null coordinates dropped (F9)."""
    pts = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return pts.groupBy(*_as_list(keys)).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("seq"), F.col(lat).alias("lat"),
                                             F.col(lon).alias("lon")))).alias("points"))
