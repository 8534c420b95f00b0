"""Reproducible global shuffle into shards by a Feistel permutation with cycle walking.

Rows get global numbers 0 .. N-1 in (id, size, checksum) order. A keyed Feistel network
permutes an a x b grid with a * b >= N > a * b - a; a position outside 0 .. N-1 is fed
through again (cycle walking), which makes the network a permutation of 0 .. N-1. The
permuted position p gives ``shard = p mod shards`` and ``slot = p div shards``: both can be
computed from the row number, the key and N alone, shard sizes differ by at most one row
(the law ``rows``), and slots have no gaps. ``row_at`` inverts the permutation.

Defined cases: null ids sort first; rows equal in id, size and checksum are repeated rows
and interchangeable; a null text has size 1 and checksum 0; an empty table gives no rows;
N <= 1 maps to position 0; other columns stay with their row.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.session import materialize

ROUNDS = 6
#: Prime below 2^31 that bounds the round function; products stay within 62 bits.
PRIME = 2147483629
WALKS = 4


def grid(n: int) -> tuple[int, int]:
    """Sides a, b with a * b >= n and less than a positions beyond n."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two multipliers a round from a linear congruential sequence over the seed."""
    out, x = [], (seed * 48271 + 11) % PRIME
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = (x * 48271 + 12345) % PRIME
            pair.append(x)
        out.append((pair[0], pair[1]))
    return out


def mix(v: Column, k: tuple[int, int]) -> Column:
    """Round function: two modular squarings, then a fold of the high half."""
    x = ((v + k[0]) % PRIME * ((v + k[1]) % PRIME)) % PRIME
    y = ((x + k[1]) % PRIME * ((x + k[0] + 7) % PRIME)) % PRIME
    return y + F.shiftright(y, 15)


def feistel_pass(rows: DataFrame, a: int, b: int, seed: int) -> DataFrame:
    """Add ``_next``: ``position`` = left + a * right after rounds that add to left mod a and right mod b in turn.

    Each round is a projection of its own, so that the expressions don't multiply.
    """
    p = F.col("position")
    d = rows.withColumns({"_l": p % a, "_r": ((p - p % a) / a).cast("long")})
    for i, k in enumerate(round_keys(seed)):
        if i % 2 == 0:
            d = d.withColumn("_l", (F.col("_l") + mix(F.col("_r"), k)) % a)
        else:
            d = d.withColumn("_r", (F.col("_r") + mix(F.col("_l"), k)) % b)
    return d.withColumn("_next", F.col("_l") + F.col("_r") * a).drop("_l", "_r")


def walk(rows: DataFrame, n: int, seed: int, first: bool) -> DataFrame:
    """Up to WALKS passes: positions that are out of range (all, on the first) are fed through."""
    a, b = grid(n)
    for i in range(WALKS):
        again = F.lit(True) if first and i == 0 else F.col("position") >= n
        rows = feistel_pass(rows, a, b, seed).withColumn(
            "position", F.when(again, F.col("_next")).otherwise(F.col("position"))).drop("_next")
    return rows


def global_rows(docs: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``docs`` with ``row_no`` 0 .. N-1 in the given order, and N; written to the shared folder.

    One range shuffle; the number inside a partition comes from the sorted scan position,
    and the partitions' offsets from their row counts (a row per partition).
    """
    d = docs.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order])
    d = materialize(d.withColumn("_at", F.monotonically_increasing_id()), "rows")
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = d.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return rows.withColumn("row_no", F.col("_before") + inner).drop("_part", "_n", "_before", "_at"), d.count()


def shuffle_positions(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Add ``position``, the keyed permutation of ``row_no``.

    The few rows still out of range after WALKS passes are walked on until none is left:
    fewer than sqrt(n) positions lie outside, so this ends, mostly at once.
    """
    out = materialize(walk(rows.withColumn("position", F.col("row_no")), n, seed, True), "positions")
    while out.where(F.col("position") >= n).limit(1).count():
        out = materialize(walk(out, n, seed, False), "positions")
    return out


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20240229, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_no, position, shard, slot) for every row of ``docs``."""
    d = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows, n = global_rows(d, [id_col, "size", "text_crc32"])
    p = F.col("position")
    return shuffle_positions(rows, n, seed).withColumns({
        "shard": (p % shards).cast("int"), "slot": ((p - p % shards) / shards).cast("long")})


def place(row_no: int, n: int, shards: int = 8, seed: int = 20240229) -> tuple[int, int]:
    """Shard and slot of one row number, computed without any data."""
    p = permute(row_no, n, seed)
    return p % shards, p // shards


def _mix(v: int, k: tuple[int, int]) -> int:
    x = ((v + k[0]) % PRIME * ((v + k[1]) % PRIME)) % PRIME
    y = ((x + k[1]) % PRIME * ((x + k[0] + 7) % PRIME)) % PRIME
    return y + (y >> 15)


def permute(p: int, n: int, seed: int) -> int:
    a, b = grid(n)
    while True:
        l, r = p % a, p // a
        for i, k in enumerate(round_keys(seed)):
            if i % 2 == 0:
                l = (l + _mix(r, k)) % a
            else:
                r = (r + _mix(l, k)) % b
        p = l + r * a
        if p < n:
            return p


def row_at(position: int, n: int, seed: int = 20240229) -> int:
    """The row number at a position: the rounds undone in reverse order."""
    a, b = grid(n)
    p = position
    while True:
        l, r = p % a, p // a
        for i, k in reversed(list(enumerate(round_keys(seed)))):
            if i % 2 == 0:
                l = (l - _mix(r, k)) % a
            else:
                r = (r - _mix(l, k)) % b
        p = l + r * a
        if p < n:
            return p
