"""Leak-free expanding averages and the carried historical state.

Reference semantics (``mode="reference"``): horizons are processed in order k = 1..K
and inside a horizon rows are taken by origin time; a row sees the carried state plus
every earlier row of the same key in that order. That is one running aggregate per key
ordered by ``(k, t_o, tiebreak...)``, excluding the current row.

``mode="strict"``: a row sees only pairs of its key that *finished* (destination time)
strictly before its origin time, plus the carried state.

A key of at most ``KEY_ROWS`` rows takes one window: one shuffle of the pairs by key, the
state joined in the same partitioning.

Skew safety: a hot key is split into blocks (``k`` and an hour bucket of the origin
time). Per-block sums/counts are pre-aggregated; an exclusive prefix over the small
block table plus the carried state gives each block's offset; only the in-block
running sum needs a window, partitioned by ``(key, block)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_null
from .sequence import route_entities, split_hot

KEY_ROWS = 1 << 18          # rows of a key whose running sums come from one window
HIST_BLOCK_SECONDS = 3600
# Fixed value: fallback speed (m/s) used for the historical time of an unseen key.
FALLBACK_SPEED_MS = 5.0


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


def build_state(pairs: DataFrame, keys, value: str = "tt", sum_col: str = "sum_tt", n_col: str = "n") -> DataFrame:
    """A5: (keys, sum, count) of ``value``; rows with a null key are left out."""
    keys = _as_list(keys)
    return (pairs.where(~any_null(keys))
            .groupBy(*keys).agg(F.sum(F.col(value)).alias(sum_col),
                                F.count(F.col(value)).alias(n_col)))


def merge_state(a: DataFrame, b: DataFrame, keys, sum_col: str = "sum_tt", n_col: str = "n") -> DataFrame:
    """A5 merge: carried + new totals."""
    keys = _as_list(keys)
    u = a.select(*keys, sum_col, n_col).unionByName(b.select(*keys, sum_col, n_col))
    return u.groupBy(*keys).agg(F.sum(sum_col).alias(sum_col), F.sum(n_col).alias(n_col))


def expanding_mean(pairs: DataFrame, keys, value: str, fallback: Column, out: str,
                   k_col: str = "k", t_col: str = "t_o", tiebreak=(), state: DataFrame | None = None,
                   mode: str = "reference", t_end_col: str | None = None,
                   sum_col: str = "sum_tt", n_col: str = "n", divide_by: float | None = None) -> DataFrame:
    """W5 + J11: ``out`` = (state.sum + sum of earlier values) / (state.n + count), or
    ``fallback`` when the count is 0; null when any key is null.

    ``t_col`` / ``t_end_col`` are numeric times (seconds). Integral values are summed
    exactly (order-independent); ``divide_by`` rescales the mean (e.g. micros -> s)."""
    keys = _as_list(keys)
    tiebreak = _as_list(tiebreak) if tiebreak else []
    if mode == "strict":
        return _expanding_strict(pairs, keys, value, fallback, out, t_col, t_end_col, tiebreak, state,
                                 sum_col, n_col, divide_by)
    order = [F.col(c).asc_nulls_last() for c in [t_col, *tiebreak]]

    def by_blocks(p):
        p = p.withColumn("_hb", F.floor(F.col(t_col) / HIST_BLOCK_SECONDS).cast("long"))
        return _running_with_offsets(p, keys, [k_col, "_hb"], order, F.col(value), F.lit(1), value, state, sum_col,
                                     n_col).drop("_hb")

    def by_key(p):
        return _running_by_key(p, keys, [F.col(k_col).asc_nulls_last(), *order], value, state, sum_col, n_col)

    hot = route_entities(pairs, keys, KEY_ROWS)
    if hot is None:
        d = by_key(pairs)
    else:
        cold, crowded = split_hot(pairs, keys, hot)
        d = by_key(cold).unionByName(by_blocks(crowded))
    mean = F.col("_s") / F.col("_n") if divide_by is None else (F.col("_s") / F.col("_n")) / F.lit(float(divide_by))
    # a pair without a horizon or an origin time has no place in the order
    res = F.when(any_null([*keys, k_col, t_col]), F.lit(None).cast("double")).when(F.col("_n") == 0, fallback.cast("double")) \
        .otherwise(mean)
    return d.withColumn(out, res).drop("_s", "_n")


def _running_by_key(d: DataFrame, keys, order, value: str, state: DataFrame | None, sum_col: str, n_col: str) -> DataFrame:
    """Exclusive running (sum, count) per key in ``order`` by one window, plus the carried state (a row a key)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = (d.withColumn("_s", F.coalesce(F.sum(value).over(w), F.lit(0)))
          .withColumn("_n", F.coalesce(F.count(value).over(w), F.lit(0))))
    if state is None:
        return d
    d = d.join(state.select(*keys, F.col(sum_col).alias("_cs"), F.col(n_col).alias("_cn")), keys, "left")
    return (d.withColumn("_s", F.col("_s") + F.coalesce(F.col("_cs"), F.lit(0)))
             .withColumn("_n", F.col("_n") + F.coalesce(F.col("_cn"), F.lit(0))).drop("_cs", "_cn"))


def _running_with_offsets(d: DataFrame, keys, blk_cols, order, v: Column, c: Column, value: str,
                          state: DataFrame | None, sum_col: str, n_col: str,
                          counted: Column | None = None) -> DataFrame:
    """Exclusive running (sum, count) per key in ``(blk_cols..., order)`` order.

    Block totals come from a partial aggregation (only per-block partial sums are
    shuffled); their exclusive prefix per key (a window over the small block table)
    plus the carried state gives each block's offset; the offsets are joined to the
    rows on ``(key, block)`` and the in-block running sum reuses that partitioning, so
    the rows are shuffled once. A hot key is spread over its blocks. ``d`` should be
    materialised (it is read twice)."""
    counted = F.col(value).isNotNull() if counted is None else counted
    vv = F.when(counted, v)
    cc = F.when(counted, c).otherwise(F.lit(0))
    blocks = d.groupBy(*keys, *blk_cols).agg(F.coalesce(F.sum(vv), F.lit(0)).alias("_bs"),
                                            F.coalesce(F.sum(cc), F.lit(0)).alias("_bc"))
    wb = (Window.partitionBy(*keys).orderBy(*[F.col(b).asc_nulls_last() for b in blk_cols])
          .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, *blk_cols, F.coalesce(F.sum("_bs").over(wb), F.lit(0)).alias("_os"),
                           F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_oc"))
    if state is not None:
        blocks = (blocks.join(state.select(*keys, sum_col, n_col), keys, "left")
                  .withColumn("_os", F.col("_os") + F.coalesce(F.col(sum_col), F.lit(0)))
                  .withColumn("_oc", F.col("_oc") + F.coalesce(F.col(n_col), F.lit(0)))
                  .drop(sum_col, n_col))
    d = d.join(blocks, [*keys, *blk_cols], "left")
    w_in = Window.partitionBy(*keys, *blk_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (d.withColumn("_s", F.col("_os") + F.coalesce(F.sum(vv).over(w_in), F.lit(0)))
             .withColumn("_n", F.col("_oc") + F.coalesce(F.sum(cc).over(w_in), F.lit(0)))
             .drop("_os", "_oc"))


def _expanding_strict(pairs, keys, value, fallback, out, t_col, t_end_col, tiebreak, state, sum_col, n_col,
                      divide_by=None):
    """Union of query rows (the pairs themselves, at origin time) and completion events
    (at destination time); a running sum over ``(t, kind)`` with completions after
    queries at the same instant counts only trips finished strictly before the origin.
    Query rows carry all their columns through the union, so no join back is needed."""
    if t_end_col is None or not tiebreak:
        raise ValueError("strict mode needs t_end_col and tiebreak columns that identify a pair")
    vtype = pairs.schema[value].dataType
    q = pairs.withColumn("_t", F.col(t_col)).withColumn("_kind", F.lit(0)) \
        .withColumn("_v", F.lit(0).cast(vtype)).withColumn("_c", F.lit(0))
    c = pairs.where(F.col(value).isNotNull()).select(
        *keys, *[F.col(x) for x in tiebreak], F.col(t_end_col).alias("_t"), F.lit(1).alias("_kind"),
        F.col(value).alias("_v"), F.lit(1).alias("_c"))
    ev = q.unionByName(c, allowMissingColumns=True).withColumn(
        "_hb", F.floor(F.col("_t") / HIST_BLOCK_SECONDS).cast("long"))
    order = [F.col("_t"), F.col("_kind"), *[F.col(x) for x in tiebreak]]
    ev = _running_with_offsets(ev, keys, ["_hb"], order, F.col("_v"), F.col("_c"), "_v", state, sum_col, n_col,
                               counted=F.lit(True))
    d = ev.where(F.col("_kind") == 0)
    mean = F.col("_s") / F.col("_n")
    if divide_by is not None:
        mean = mean / F.lit(float(divide_by))
    res = F.when(any_null(keys), F.lit(None).cast("double")).when(F.col("_n") == 0, fallback.cast("double")) \
        .otherwise(mean)
    return d.withColumn(out, res).drop("_s", "_n", "_t", "_kind", "_v", "_c", "_hb")


def lookup_state(df: DataFrame, state: DataFrame, keys, sum_col: str = "sum_tt", n_col: str = "n") -> DataFrame:
    """Prior (sum, count) per key, default (0, 0)."""
    keys = _as_list(keys)
    return (df.join(state.select(*keys, sum_col, n_col), keys, "left")
            .withColumn(sum_col, F.coalesce(F.col(sum_col), F.lit(0)))
            .withColumn(n_col, F.coalesce(F.col(n_col), F.lit(0))))


def fallback_time(distance_m) -> Column:
    """Historical time of an unseen key: distance at 5 m/s."""
    d = F.col(distance_m) if isinstance(distance_m, str) else distance_m
    return d / F.lit(FALLBACK_SPEED_MS)
