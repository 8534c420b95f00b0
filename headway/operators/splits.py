"""Out-of-time splits and deterministic sampling.

No operator here uses a global single-partition sort of the data:
``split_fraction`` finds the time at which the cut lies by counts of time spans and orders only the rows there.
Sampling is hash-based (repeatable across re-runs
and executor loss), never ``rand()`` after a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .sequence import _as_list, _ord


def split_date(df: DataFrame, ts: str, cutoff: str, end: str | None = None, out: str = "split") -> DataFrame:
    """``train`` before ``cutoff``; ``test`` from ``cutoff`` (and before ``end``
    when given, later rows are dropped). Null times are dropped."""
    t = F.col(ts)
    lab = F.when(t < F.lit(cutoff).cast(df.schema[ts].dataType), "train")
    test = t >= F.lit(cutoff).cast(df.schema[ts].dataType)
    if end is not None:
        test = test & (t < F.lit(end).cast(df.schema[ts].dataType))
    lab = lab.when(test, "test")
    return df.withColumn(out, lab).where(F.col(out).isNotNull())


def global_row_numbers(df: DataFrame, order, out: str = "_row", part: str | None = None) -> tuple[DataFrame, int]:
    """Add ``out``: 0 .. n-1 in ``order`` (nulls last), and return n. ``part`` keeps the number of the row's range.

    One range shuffle; the sorted rows are written to the shared folder with their place in
    their range, and the ranges' offsets come from their row counts, a row per range (so the
    broadcast is bounded by the number of shuffle partitions). No
    task holds more than a range, however many rows share a day or a time block."""
    keys = _ord(_as_list(order))
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    d = materialize(d, "ordered")
    at = F.shiftright("_at", 33)                           # the id is (partition << 33) + place
    sizes = d.groupBy(at.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = d.withColumn("_part", at).join(F.broadcast(sizes.drop("_n")), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn(out, F.col("_before") + place)
    rows = rows.withColumnRenamed("_part", part) if part else rows.drop("_part")
    return rows.drop("_before", "_at"), d.count()


SPANS = 4096                # spans in which rows are counted to find a cut
EDGE_ROWS = 1 << 18         # rows around a cut that are ordered


def split_fraction(df: DataFrame, order, frac: float = 0.8, out: str = "split") -> DataFrame:
    """The first ``floor(n * frac)`` rows by ``order`` are ``train``, the rest
    ``test`` (exactly as a global row number would give, ties broken by ``order``).

    The rows are written once. When ``order`` starts with whole numbers or times, row counts of ``SPANS``
    spans tell in which span the cut lies; that span is counted in turn until it has at most ``EDGE_ROWS``
    rows or one value. Only its rows are ordered (by ``global_row_numbers``); those before and after need no
    shuffle."""
    order = _as_list(order)
    first = order[0]
    kind = df.schema[first].dataType if isinstance(first, str) else None
    d = materialize(df, "rows")
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    x = F.col(first).cast("long") if whole else F.unix_micros(first) if isinstance(kind, T.TimestampType) else None
    r = None if x is None else d.agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("known"), F.min(x).alias("lo"),
                                     F.max(x).alias("hi")).first()
    if r is None or (r.known and r.hi - r.lo >= 1 << 63):  # a distance of longs that is no long
        rows, n = global_row_numbers(d, order)
        return rows.withColumn(out, F.when(F.col("_row") < math.floor(n * frac), "train").otherwise("test")).drop("_row")
    cut = math.floor(r.n * frac)
    label = lambda is_train: F.when(is_train, "train").otherwise("test")
    if cut <= 0 or cut >= r.n:
        return d.withColumn(out, label(F.lit(cut > 0)))
    if cut >= r.known:                                     # nulls come last, the cut lies among them
        before, edge = x.isNotNull(), x.isNull()
        rest = cut - r.known
    else:
        lo, hi, rest = r.lo, r.hi, cut
        while True:
            width = (hi - lo) // SPANS + 1
            at = F.call_function("div", x - F.lit(lo), F.lit(width))
            counts = dict(map(tuple, d.where(x.between(lo, hi)).groupBy(at.alias("_at")).agg(F.count(F.lit(1))).collect()))
            for i in sorted(counts):
                if rest < counts[i]:
                    break
                rest -= counts[i]
            lo, hi = lo + i * width, min(hi, lo + (i + 1) * width - 1)
            if lo == hi or counts[i] <= EDGE_ROWS:
                break
        before, edge = F.coalesce(x < lo, F.lit(False)), F.coalesce(x.between(lo, hi), F.lit(False))
    if not rest:
        return d.withColumn(out, label(before))
    at_edge, _ = global_row_numbers(d.where(edge), order)
    return d.where(~edge).withColumn(out, label(before)).unionByName(
        at_edge.withColumn(out, label(F.col("_row") < rest)).drop("_row"))


def split_fraction_by_entity(df: DataFrame, entity, order_col: str, frac: float = 0.8,
                             out: str = "split") -> DataFrame:
    """T4: entities (trips) ordered by their first ``order_col``; the first
    ``floor(n_entities * frac)`` are train. No entity is cut in two."""
    entity = _as_list(entity)
    d = materialize(df, "rows")
    starts = d.groupBy(*entity).agg(F.min(order_col).alias("_start"))
    lab = split_fraction(starts, ["_start", *entity], frac, out)
    return materialize(d.join(lab.select(*entity, out), entity, "left"), "labelled")


def unit_hash(key_cols, seed: int = 42) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the keys (as text, ``|`` between, a null is empty): the
    same on every run and in any system that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _as_list(key_cols)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


def holdout_flag(key_cols, pct: float, seed: int = 42) -> Column:
    """Stable hold-out membership of about ``pct`` per cent of the keys."""
    return unit_hash(key_cols, seed) < F.lit(pct / 100.0)


def hash_sample(df: DataFrame, key_cols, fraction: float, seed: int = 42) -> DataFrame:
    """Repeatable sample of about ``fraction`` of the rows."""
    return df.where(unit_hash(key_cols, seed) < F.lit(float(fraction)))


def row_cap(df: DataFrame, key_cols, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), those with the smallest hashes, ties by the keys.

    One partial count over hash ranges finds the range in which the n-th row lies; only that range is
    ordered (by ``global_row_numbers``), the ranges before it are taken whole."""
    keys = _as_list(key_cols)
    d = df.withColumn("_u", unit_hash(keys, seed))
    cells = 1 << 12
    cell = F.floor(F.col("_u") * cells)
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = d.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    edge = counts.where(F.col("_upto") >= n).orderBy("_cell").select("_cell", (F.lit(n) - F.col("_upto") + F.col("_n")).alias("_rest")).first()
    if edge is None:
        return df
    last, _ = global_row_numbers(d.where(cell == edge["_cell"]), ["_u", *keys])
    return d.where(cell < edge["_cell"]).drop("_u").unionByName(last.where(F.col("_row") < edge["_rest"]).drop("_u", "_row"))


def stratified_sample(df: DataFrame, stratum: str, key_cols, fraction: float, seed: int = 42) -> DataFrame:
    """The same fraction from every stratum (e.g. every horizon ``k``), hash-based. A smaller fraction of
    the same seed is a part of a larger one."""
    return df.where(unit_hash([stratum, *_as_list(key_cols)], seed) < F.lit(float(fraction)))


def sample_entities(df: DataFrame, entity: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct entities chosen by a seeded hash order (the limit is the
    feature; a top-k per task, then one merge), then every row of those entities (J15)."""
    from .enrich import keep_members
    ids = df.select(entity).where(F.col(entity).isNotNull()).distinct()
    ids = ids.orderBy(unit_hash([entity], seed), F.col(entity)).limit(n)
    return keep_members(df, ids, entity)


def representative(df: DataFrame, group_col: str, wanted: DataFrame, id_col: str, seed: int = 42,
                   fallback_value=5) -> DataFrame:
    """One deterministic row per requested group value (``min_by`` over a seeded
    hash of the id, the same on every run, unlike a per-process string hash); a request
    whose group is absent gets the representative of ``fallback_value``."""
    reps = df.groupBy(group_col).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]),
                                              F.xxhash64(F.lit(seed), F.col(id_col))).alias("_row"))
    req = wanted.withColumn("_g", F.col(group_col))
    hit = req.join(reps, req["_g"] == reps[group_col], "left").drop(reps[group_col])
    # at most one row: the representative of the fallback group, as a scalar subquery
    fb = reps.where(F.col(group_col) == F.lit(fallback_value)).select(F.col("_row")).scalar()
    return hit.withColumn("_row", F.coalesce(F.col("_row"), fb)).drop("_g")


def first_by(df: DataFrame, keys, order, cols=None) -> DataFrame:
    """First row per key by an explicit order (e.g. first trip of a route)."""
    from .sequence import keep_first
    return keep_first(df, keys, order, cols)


def complement(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``flag`` true, the rest) from one boolean column."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return df.where(f), df.where(~f)
