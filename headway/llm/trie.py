"""Prefix trie of conversations, with subtree totals by time-forward processing.

Every conversation is first rebuilt: up to three leading turns come from the conversation
whose id is the next lower multiple of ``family``. A node is a distinct sequence of leading
turns; it is named by its depth and two 64-bit hashes, each the XOR of the turns' hashes
mixed with their places. XOR needs no order, so a prefix hash is a running XOR inside a
stretch of a conversation plus the XOR of the stretches before it: no task holds a whole
conversation. (owner, depth) names a node as well, the owner being its smallest member.

Subtree totals. A node is *heavy* when it has more than ``instances / MAX_HEAVY`` members;
each turn has one node, so there are fewer than ``MAX_HEAVY`` heavy nodes whatever the
input, and they may be broadcast. Below them hang light subtrees, and no light subtree is cut:
a shard is the light subtrees dealt to one task. A task reads its nodes in reverse level
order (Spark's external sort) and passes each node's totals forward to its parent through a
priority queue that spills sorted runs (``SpillingQueue``). The totals of the shards' roots
are summed by parent, and the same pass over the heavy nodes (one task, fewer than
``MAX_HEAVY`` rows) finishes the tree. A node of one conversation needs no pass: one leaf
lies below it and nothing is shared.

Defined cases: a null role or text is empty; rows of one turn are ordered by role, then
text; repeated rows are repeated turns; a null turn comes first; rows without a conv_id
belong to no conversation and are left out; a conversation that loses all its turns is
counted at the root; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.llm.common import split_words
from headway.operators.splits import global_row_numbers
from headway.session import materialize

#: Fewer nodes than this are heavy.
MAX_HEAVY = 1 << 16
#: Messages that a task keeps in memory before it spills a sorted run.
QUEUE_LIMIT = 1 << 18
#: Most leading turns that come from another conversation.
MAX_HEAD = 3
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """A priority queue of equally long tuples of 64-bit integers, in bounded memory.

    Beyond ``limit`` messages the heap is written as one sorted run to an unnamed file in
    Spark's own spill folder of the task; runs are read back block by block. A lost
    executor loses nothing but the task, which starts again from its input.
    """

    def __init__(self, limit: int = QUEUE_LIMIT, block: int = 4096):
        self.limit, self.block = limit, block
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []                     # heap of (message, run number, rest of the run)
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        width = len(self.heap[0])
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        f = tempfile.TemporaryFile(dir=folder)
        np.array(sorted(self.heap), dtype=np.int64).tofile(f)
        f.seek(0)
        self.heap = []
        self.spilled += 1
        rest = self._read(f, width)
        heapq.heappush(self.runs, (next(rest), self.spilled, rest))

    def _read(self, f, width: int):
        with f:
            while len(rows := np.fromfile(f, dtype=np.int64, count=self.block * width)):
                yield from map(tuple, rows.reshape(-1, width).tolist())

    def peek(self) -> tuple | None:
        a = self.heap[0] if self.heap else None
        b = self.runs[0][0] if self.runs else None
        return a if b is None or (a is not None and a <= b) else b

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        message, number, rest = self.runs[0]
        after = next(rest, None)
        if after is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (after, number, rest))
        return message


def time_forward(limit: int = QUEUE_LIMIT):
    """A pass over nodes sorted by (depth descending, conv_id): adds to ``n_children``, ``n_leaves``
    and ``saved_tokens`` what the children have passed; a node whose ``passes`` is set passes its
    totals on to (parent_conv_id, depth - 1)."""
    def run(batches):
        queue = SpillingQueue(limit)
        for b in batches:
            names = b.schema.names
            cols = [b.column(names.index(c)).to_pylist() for c in
                    ("depth", "conv_id", "parent_conv_id", "passes", "n_children", "n_leaves", "saved_tokens")]
            sums: tuple[list, list, list] = ([], [], [])
            for depth, conv, parent, passes, children, leaves, saved in zip(*cols):
                at = (-depth, conv)
                while (head := queue.peek()) is not None and head[:2] == at:
                    message = queue.pop()
                    children, leaves, saved = children + 1, leaves + message[2], saved + message[3]
                for out, value in zip(sums, (children, leaves, saved)):
                    out.append(value)
                if passes:
                    queue.push((1 - depth, parent, leaves, saved))
            for name, out in zip(("n_children", "n_leaves", "saved_tokens"), sums):
                b = b.set_column(names.index(name), name, pa.array(out, pa.int64()))
            yield b
        if queue.peek() is not None:
            raise ValueError("a message has no node")
    return run


def _join_digests(batches):
    """SHA-256 of each node's ids from pieces sorted by (node, piece); a node may span batches."""
    key, sha = None, None
    schema = pa.schema([(c, pa.int64()) for c in ("depth", "x1", "x2")] + [("ends_sha256", pa.string())])
    for b in batches:
        done = []
        for *node, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "x1", "x2", "ids"))):
            if node != key:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, sha.hexdigest()), schema)],
                                         schema=schema)


def head_turns(conv_id: Column) -> Column:
    """Leading turns taken from the family's first conversation: unsigned crc32 of the decimal id, modulo 4."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MAX_HEAD + 1)).cast("long")


def ordered_turns(conversations: DataFrame, *extra: Column) -> DataFrame:
    """Rows in (conv_id, turn, role, text) order with their global number ``g`` and range ``part``.

    One range shuffle; a conversation with many rows is spread over several ranges, equal
    rows included (the last key only tells them apart).
    """
    d = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("copy"))
    order = [F.col("conv_id"), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("text"), F.col("copy")]
    rows, _ = global_row_numbers(d, order, "g", part="part")
    return rows.select("part", "g", "conv_id", *extra)


def _mix(seed: int, depth: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth, F.col("k1"), F.col("k2"))


def _placed(conversations: DataFrame, family: int) -> tuple[DataFrame, DataFrame]:
    """(turns with their own prefix hashes, rebuilt conversations with their heads)."""
    rows = materialize(ordered_turns(
        conversations, F.xxhash64("role", "text").alias("k1"),
        F.xxhash64(F.lit(7), F.length("role"), "text", "role").alias("k2"),
        F.size(split_words(F.col("text"))).cast("long").alias("words")), "turns")
    pairs = rows.groupBy("conv_id", "part").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    pairs = pairs.select("conv_id", "part", F.min("first").over(whole).alias("start"), F.sum("n").over(whole).alias("n"),
                         (F.count(F.lit(1)).over(whole) > 1).alias("cut"))
    pairs = materialize(pairs, "stretches")
    placed = rows.join(pairs, ["conv_id", "part"]).withColumn("pos", F.col("g") - F.col("start") + 1)

    lead = placed.where(F.col("pos") <= MAX_HEAD).select(
        "conv_id", F.struct("pos", _mix(1, F.col("pos")).alias("m1"), _mix(2, F.col("pos")).alias("m2"), "words").alias("t"))
    heads = lead.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("head"))
    convs = pairs.groupBy("conv_id").agg(F.first("n").alias("n")).withColumn("h", head_turns(F.col("conv_id")))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1),
                                F.col("h").cast("int")).alias("head"), "n")
    fold = lambda f: F.aggregate("head", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t[f]))
    convs = materialize(convs.select(
        "conv_id", "h", "head", fold("m1").alias("h1"), fold("m2").alias("h2"), F.size("head").cast("long").alias("m"),
        (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")), "rebuilt")

    # Join and running XOR share one exchange by (conversation, stretch).
    stretch = pairs.join(convs.drop("head"), "conv_id")
    own = rows.join(stretch, ["conv_id", "part"]).withColumn("pos", F.col("g") - F.col("start") + 1)
    own = own.where(F.col("pos") > F.col("h")).withColumn("depth", F.col("pos") - F.col("h") + F.col("m"))
    own = own.withColumn("m1", _mix(1, F.col("depth"))).withColumn("m2", _mix(2, F.col("depth")))
    w = Window.partitionBy("conv_id", "part").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    own = materialize(own.select(
        "conv_id", "part", "cut", "length", "depth", "words", "m1", "m2",
        F.col("h1").bitwiseXOR(F.bit_xor("m1").over(w)).alias("x1"),
        F.col("h2").bitwiseXOR(F.bit_xor("m2").over(w)).alias("x2")), "prefixes")
    # Conversations that span ranges: at most two stretches a range, so the broadcast is bounded by the ranges.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.where("cut").groupBy("conv_id", "part").agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"))
    offsets = offsets.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"o{c[1]}")
                                                  for c in ("b1", "b2")])
    own = own.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    for i in "12":
        own = own.withColumn(f"x{i}", F.col(f"x{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))))
    return own, convs


def trie_instances(conversations: DataFrame, family: int = 20) -> DataFrame:
    """A row for each rebuilt conversation and node on its path: conv_id, depth, the node's hashes
    x1, x2 and its parent's p1, p2, the words of its last text, and whether the conversation ends there."""
    own, convs = _placed(conversations, family)
    up = [F.col(f"x{i}").bitwiseXOR(F.col(f"m{i}")).alias(f"p{i}") for i in "12"]
    cols = ["conv_id", "depth", "x1", "x2", *up, "words", (F.col("depth") == F.col("length")).alias("ends")]
    lead = convs.select("conv_id", "length", "head", F.posexplode("head").alias("k", "t"))
    upto = lambda f: F.aggregate(F.slice("head", F.lit(1), F.col("k") + 1), F.lit(0).cast("long"),
                                 lambda a, t: a.bitwiseXOR(t[f]))
    lead = lead.select("conv_id", "length", F.col("t.pos").alias("depth"), F.col("t.words").alias("words"),
                       F.col("t.m1").alias("m1"), F.col("t.m2").alias("m2"), upto("m1").alias("x1"), upto("m2").alias("x2"))
    none = F.lit(0).cast("long")
    root = convs.select("conv_id", none.alias("depth"), none.alias("x1"), none.alias("x2"), none.alias("p1"),
                        none.alias("p2"), none.alias("words"), (F.col("length") == 0).alias("ends"))
    return materialize(own.select(*cols).unionByName(lead.select(*cols)).unionByName(root), "paths")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """A row for each node, with its parent's owner and member count. Paths are counted before they are shuffled."""
    nodes = materialize(paths.groupBy("depth", "x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"), F.max("words").alias("words"), F.count_if("ends").alias("n_ends"),
        F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("first_end")), "nodes")
    top = nodes.where("depth = 0").select("conv_id", F.col("n_convs").alias("n")).limit(1)
    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"),
                                            F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
                                            F.col("n_convs").alias("parent_convs"))
    deep = nodes.where("depth > 1").join(above, ["depth", "p1", "p2"])
    # All first turns share the root: its owner is one value, not a join.
    first = nodes.where("depth = 1").withColumn("parent_conv_id", top.select("conv_id").scalar()).withColumn(
        "parent_convs", top.select("n").scalar())
    root = nodes.where("depth = 0").withColumns({c: F.lit(None).cast("long") for c in ("parent_conv_id", "parent_convs")})
    return materialize(deep.unionByName(first).unionByName(root), "family").drop("p1", "p2")


def end_digests(paths: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node. Ids are joined in pieces of at most 256 before the last
    shuffle; a digest runs through its pieces in order, so one task streams them and keeps one hash state."""
    ends = paths.where("ends").withColumn("piece", F.shiftright("conv_id", 8))
    pieces = ends.groupBy("depth", "x1", "x2", "piece").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    node = ["depth", "x1", "x2"]
    pieces = pieces.repartition(*node).sortWithinPartitions(*node, "piece")
    return pieces.mapInArrow(_join_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 20, max_heavy: int = MAX_HEAVY,
                queue_limit: int = QUEUE_LIMIT) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words of last texts that members share, summed over the subtree), ends_sha256."""
    paths = trie_instances(conversations, family)
    nodes = trie_nodes(paths)
    most = paths.count() // max_heavy + 1                  # heavy: more members; fewer than max_heavy such nodes
    zero = F.lit(0).cast("long")
    alone = F.col("n_convs") == 1
    nodes = nodes.withColumns({
        "n_children": zero,
        "n_leaves": F.when(alone | (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})

    heavy = nodes.where(F.col("n_convs") > most)
    keys = F.broadcast(heavy.select("depth", "x1", "x2", F.lit(True).alias("heavy")))
    light_path = paths.join(keys, ["depth", "x1", "x2"], "left").where("heavy IS NULL")
    root = light_path.groupBy("conv_id").agg(F.min(F.struct("depth", "x1", "x2")).alias("light_root"))

    # Nodes of one conversation below another such node are settled; the others take the pass.
    settled = alone & (F.col("parent_convs") == 1)
    work = nodes.where((F.col("n_convs") <= most) & ~F.coalesce(settled, F.lit(False))).join(root, "conv_id")
    work = work.withColumn("passes", F.col("depth") > F.col("light_root.depth"))
    work = work.repartition("light_root").drop("light_root").sortWithinPartitions(F.desc("depth"), "conv_id")
    done = materialize(work.mapInArrow(time_forward(queue_limit), work.schema), "shards")

    sent = done.where(~F.col("passes") & (F.col("depth") > 0)).groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    top = heavy.join(sent, ["conv_id", "depth"], "left").withColumns({
        "n_children": F.coalesce("c", zero), "n_leaves": F.col("n_leaves") + F.coalesce("l", zero),
        "saved_tokens": F.col("saved_tokens") + F.coalesce("s", zero), "passes": F.col("depth") > 0}).drop("c", "l", "s")
    top = top.select(*done.columns).coalesce(1).sortWithinPartitions(F.desc("depth"), "conv_id")
    top = top.mapInArrow(time_forward(queue_limit), done.schema)

    all_nodes = done.unionByName(top).unionByName(
        nodes.where(settled & (F.col("n_convs") <= most)).withColumn("passes", F.lit(False)))
    all_nodes = all_nodes.withColumn("n_children", F.when(alone, (F.col("n_ends") == 0).cast("long"))
                                     .otherwise(F.col("n_children")))
    one = F.when(F.col("n_ends") == 0, EMPTY_SHA256).when(
        F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string").cast("binary"), 256))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    many = all_nodes.where("n_ends > 1").join(end_digests(paths), ["depth", "x1", "x2"])
    return all_nodes.where("n_ends < 2").select(*out, one.alias("ends_sha256")).unionByName(
        many.select(*out, "ends_sha256"))
