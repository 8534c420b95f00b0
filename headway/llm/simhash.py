"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint sums, bit by bit, the 64-bit hashes of its word shingles (repeats
included). Fingerprints link at ``max_bits`` = 2 or fewer differing bits, and documents
connected by links form a component.

Only distinct fingerprints are compared. Each is cut into two 32-bit segments; two
fingerprints that differ in at most 2 bits differ in at most 1 bit of some segment. So the
table has a row per fingerprint and segment, keyed by the segment's value, and a
fingerprint enumerates in each segment the ball of radius 1: the value itself, and the value
with one set bit cleared (of two values that differ in one bit, one has it set, so the other
direction need not be asked). Matches are verified on all 64 bits.

A segment value shared by more than ``HOT`` fingerprints would pair up quadratically. All
fingerprints that lie in such a bucket or ask for it are compared instead by keys that hold
the complete fingerprint: each emits itself and its 64 one-bit neighbours. Members of one key
are within 2 bits of each other by construction and a key has at most 65, so linking each to
the key's smallest member loses no connection and makes no pairs.

Components come from alternating large-star and small-star steps, each written to the shared
folder; nodes are fingerprints, never documents.

Defined cases: a text without words has fingerprint zero, linked like any other; fewer words
than a shingle are one shingle; repeated ids are separate rows; a component whose ids are all
null has a null id; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from headway.session import materialize

HOT = 64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HASHES_AT_ONCE = 1 << 17


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text (UTF-8)."""
    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    a, b = starts[:n].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, HASHES_AT_ONCE):                 # bounded, however long the text
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(a[lo:lo + HASHES_AT_ONCE],
                                                                   b[lo:lo + HASHES_AT_ONCE])), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text") -> DataFrame:
    """The ``keep`` columns and fp, the fingerprint as a signed 64-bit integer."""
    schema = StructType([*(docs.schema[c] for c in keep), StructField("fp", LongType())])

    def run(batches):
        for b in batches:
            fps = [fingerprint(t or b"", shingle, seed) for t in b.column(len(keep)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(fps, "<u8").view("<i8"))],
                                             [*keep, "fp"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def segment(fp: Column, s: int) -> Column:
    """Segment 0 (low) or 1 (high) as a non-negative long."""
    return F.shiftrightunsigned(fp, 32 * s).bitwiseAND(F.lit((1 << 32) - 1))


def _bits(n: int) -> Column:
    return F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(n)])


def probes(fp: Column, s: int) -> Column:
    """The segment's value, and the value with each of its set bits cleared."""
    v = segment(fp, s)
    return F.concat(F.array(v), F.transform(
        F.filter(_bits(32), lambda b: v.bitwiseAND(b) != 0), lambda b: v.bitwiseXOR(b)))


def link_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b), a != b, between distinct fingerprints ``fp``; connect exactly what links connect."""
    if max_bits != 2:
        raise ValueError("two segments with a ball of radius 1 serve a distance of 2")
    f = fps.select("fp")
    table = materialize(f.select("fp", F.posexplode(F.array(segment(F.col("fp"), 0), segment(F.col("fp"), 1)))
                                 .alias("s", "v")), "segments")
    hot = materialize(table.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
                      .select("s", "v"), "hot")
    asked = f.select("fp", F.posexplode(F.array(probes(F.col("fp"), 0), probes(F.col("fp"), 1))).alias("s", "vs")) \
        .select("fp", "s", F.explode("vs").alias("v"))
    cool = table.join(hot, ["s", "v"], "left_anti")            # before the join, which would pair up a hot bucket
    # sizes are estimated from a fingerprint's file, about 35 times below what a ball holds: never broadcast it
    met = cool.join(asked.withColumnRenamed("fp", "other").hint("merge"), ["s", "v"])
    cold = met.where((F.col("fp") != F.col("other"))
                     & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)).select(
        F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
    crowded = asked.join(hot, ["s", "v"], "left_semi").select("fp").distinct()   # the ball holds the value itself
    keys = crowded.select("fp", F.explode(F.concat(F.array("fp"), F.transform(
        _bits(64), lambda b: F.col("fp").bitwiseXOR(b)))).alias("key"))
    star = keys.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("all")).where(F.size("all") > 1).select(
        F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("a"), F.get("all", 0).alias("b"))
    return cold.union(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); root is the smallest node of the component."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large-star: a node's larger neighbours move to its smallest neighbour (or itself).
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Small-star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, "edges")
        # Done when every node has one parent and no parent has a parent of its own: all are stars.
        parents = small.select(F.col("b").alias("p")).distinct()
        if not small.join(parents, F.col("a") == F.col("p"), "left_semi").limit(1).count() \
                and not small.groupBy("a").count().where("count > 1").limit(1).count():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                parents.select(F.col("p").alias("node"), F.col("p").alias("root")))
        e = small


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42,
                    keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, fp, root (the component's smallest fingerprint) of every row of ``docs``."""
    f = materialize(fingerprints(docs, shingle, seed, keep, text), "fingerprints")
    distinct = materialize(f.select("fp").distinct(), "distinct")
    roots = components(link_fingerprints(distinct, max_bits)).where(F.col("node") != F.col("root"))
    return f.join(roots, F.col("fp") == F.col("node"), "left").select(
        *keep, "fp", F.coalesce("root", "fp").alias("root"))


def with_component_ids(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id of the component."""
    found = materialize(found, "roots")
    least = found.groupBy(F.col("root").alias("_r")).agg(F.min(id_col).alias("component_id"))
    return found.join(least, F.col("root") == F.col("_r")).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
