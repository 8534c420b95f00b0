"""Conversation structure repair: cheapest edits, then the least audit by prefix doubling.

A conversation's rows (after ``damaged``, which plants the faults) are repaired so that the
roles' initials read ``(s?(ua)+)?``. Keep costs 0, Rerole 3, Delete 4 (blank and duplicate
rows must go), Insert 3; a truncated row that is not deleted adds 3. The audit is the edits'
initials; of the cheapest audits the least one (as text) wins.

The four states (0 nothing yet, 1 after system, 2 after user, 3 after assistant) and the
place in the conversation make the nodes; an edit is an arc, and a node and a letter have one
target. Two steps for each block of at most ``BLOCK`` rows:

* Cost DP, from the last row to the first: the cheapest cost to the end from every node.
  A block's costs depend on what follows only through the four costs at its end; blocks of
  long conversations hand on 4 x 4 cost tables, which combine like matrices, so every block
  learns its end costs from a row a block and not from the rows.
* Path ranking: the arcs that keep the cost are the optimal ones. Nodes are ranked by the
  first letter of their least audit, then by 2, 4, 8, ... letters: the rank of 2n letters
  is the rank of the pair (rank of n letters, rank of the node n letters on). Pointers double
  with the ranks. The final ranks choose each node's arc, and the doubled pointers of these
  arcs give the whole path: the first 2n nodes are the first n and their images n letters on.

So no task holds a conversation: rows are dealt by range, symbols (one byte a row) by block.
Only the digest of the repaired text runs through a conversation in order; one task streams
it and holds a block's edits and a hash state.

Defined cases: a null role or text is one space (as are null ids and turns inside the
damage key); rows of one turn are ordered by role, then text; a null turn comes first;
repeated rows are repeated turns; a role whose initial is not s, u or a needs another role
or goes; rows without a conv_id belong to no conversation and are left out; a conversation
without rows after the damage is returned with zeros; other columns are ignored; an empty
table gives an empty output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from headway.operators.splits import global_row_numbers
from headway.session import materialize

#: Rows of a block.
BLOCK = 1 << 14
#: Blocks of fewer rows are ranked together.
SHORT = 64
LETTERS = "DIKR"                                           # in ASCII order
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INF = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
INITIALS = "sua"                                           # symbols 0, 1, 2; any other initial: 3
#: State after a row of each symbol is kept (-1: not allowed), and after a new role.
AFTER_KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
AFTER_NEW = (2, 2, 3, 2)
NEW_ROLE = ("user", "user", "assistant", "user")
AT_END = (0, INF, INF, 0)                                  # the empty sequence, or one that ends with an assistant


# ---------------------------------------------------------------- faults
def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20: drop, empty, unpunctuate, repeat or rerole a row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    d = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                 text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return d.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows in (conv_id, turn, role, text) order with their global number ``g``, range ``part`` and symbol.

    One range shuffle, so a conversation with many rows, or many equal ones, is spread.
    """
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text",
                    F.monotonically_increasing_id().alias("copy"))
    order = [F.col("conv_id"), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("text"), F.col("copy")]
    d, _ = global_row_numbers(d, order, "g", part="part")
    initial, symbol = F.substring("role", 1, 1), F.lit(len(INITIALS))
    for k, c in enumerate(INITIALS):
        symbol = F.when(initial == c, k).otherwise(symbol)
    return d.select("conv_id", "part", "g", "turn", "role", "text", symbol.alias("symbol"))


def faults(ordered: DataFrame) -> DataFrame:
    """(conv_id, g, pos, turn, symbol, fault): ``pos`` is 0, 1, ... in the conversation. The first of the
    rows with one role and text is found by an aggregation and joined by its number, so equal rows meet in no task."""
    start = ordered.groupBy("conv_id", "part").agg(F.min("g").alias("start"))
    start = start.withColumn("start", F.min("start").over(Window.partitionBy("conv_id")))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    d = ordered.select("conv_id", "part", "g", "turn", "symbol", last.alias("last"), F.xxhash64("role", "text").alias("k1"),
                       F.xxhash64(F.lit(7), F.length("role"), "text", "role").alias("k2"))
    d = d.join(start, ["conv_id", "part"]).withColumn("pos", F.col("g") - F.col("start"))
    d = materialize(d.drop("part", "start"), "numbered")
    first = d.groupBy("conv_id", "k1", "k2").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("new"))
    d = d.drop("k1", "k2").join(first, "g", "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("new").isNull(), "duplicate").when(
        ~F.col("last").isin(".", "!", "?"), "truncated")
    return materialize(d.select("conv_id", "g", "pos", "turn", "symbol", fault.alias("fault")), "faults")


def symbol_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, g, symbols): a byte a row, its symbol plus 4 (must go) or 8 (truncated); g is the first row's."""
    code = F.col("symbol") + F.when(F.col("fault") == "truncated", 8).when(F.col("fault").isNotNull(), 4).otherwise(0)
    at = rows.select("conv_id", F.floor(F.col("pos") / block).alias("block"), "g", code.alias("code"))
    one = F.lpad(F.hex("code"), 2, "0")
    b = at.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("g", one.alias("x")))).alias("s"))
    return b.select("conv_id", "block", F.get("s", F.lit(0))["g"].alias("g"), F.unhex(F.array_join("s.x", "")).alias("symbols"))


# ---------------------------------------------------------------- cost DP
def consume(code: int, after) -> list[list]:
    """Per state the (cost, letter, target) arcs over one row, ``after`` being the costs behind it."""
    symbol, must_go, late = code & 3, code & 4, TRUNCATED if code & 8 else 0
    arcs = []
    for q in range(4):
        out = [(DELETE + after[q], 0, q)]
        if not must_go:
            kept = AFTER_KEEP[q][symbol]
            if kept >= 0:
                out.append((late + after[kept], 2, kept))
            out.append((late + REROLE + after[AFTER_NEW[q]], 3, AFTER_NEW[q]))
        arcs.append(out)
    return arcs


def with_inserts(best: list[int]) -> list[int]:
    """Costs of one place when rows may also be inserted there (at most two in a row can pay)."""
    user = min(best[2], INSERT + best[3])
    assistant = min(best[3], INSERT + best[2])
    return [min(best[0], INSERT + user), min(best[1], INSERT + user), user, assistant]


def block_costs(symbols: bytes, behind) -> list[list[int]]:
    """Costs at every place of a block (n_rows + 1 rows of 4), given the costs behind its last row."""
    costs = [list(behind)]
    for code in reversed(symbols):
        costs.append(with_inserts([min(a[0] for a in arcs) for arcs in consume(code, costs[-1])]))
    costs.reverse()
    return costs


#: Costs behind the last row of a conversation, inserts included.
END_COSTS = tuple(with_inserts(list(AT_END)))


def cost_table(symbols: bytes) -> list[int]:
    """16 costs: from state q at the first place to state e behind the last row, at 4 * q + e."""
    ends = [block_costs(symbols, [0 if s == e else INF for s in range(4)])[0] for e in range(4)]
    return [min(ends[e][q], INF) for q in range(4) for e in range(4)]


def _cost_tables(batches):
    for b in batches:
        tables = [cost_table(s) for s in b.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(tables, pa.list_(pa.int64()))],
                                         names=["conv_id", "block", "table"])


def _end_costs(batches):
    """Cost tables sorted by (conv_id, last block first) to the costs behind each block."""
    conv, behind = None, None
    for b in batches:
        out = []
        for c, table in zip(b.column("conv_id").to_pylist(), b.column("table").to_pylist()):
            if c != conv:
                conv, behind = c, list(END_COSTS)
            out.append(behind)
            behind = [min(INF, min(table[4 * q + e] + behind[e] for e in range(4))) for q in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(out, pa.list_(pa.int64()))],
                                         names=["conv_id", "block", "behind"])


# ---------------------------------------------------------------- path ranking
def optimal_arcs(symbols: bytes, behind, last: bool) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(targets, costs): targets[node, letter] is the node that an optimal arc leads to, -1 without one.

    Node 4 * place + state. In the last block rows may also be inserted behind the last row;
    other blocks leave that to the block that follows.
    """
    costs = block_costs(symbols, behind)
    n = len(symbols)
    to = np.full((4 * (n + 1), 4), -1, np.int64)
    for i in range(n + 1):
        here = costs[i]
        if i < n:
            for q, arcs in enumerate(consume(symbols[i], costs[i + 1])):
                for cost, letter, target in arcs:
                    if cost == here[q] < INF:
                        to[4 * i + q, letter] = 4 * (i + 1) + target
        elif not last:
            break
        for q in range(4):
            if INSERT + here[AFTER_NEW[q]] == here[q] < INF:
                to[4 * i + q, 1] = 4 * i + AFTER_NEW[q]
    return to, costs


def rank_paths(to: np.ndarray) -> np.ndarray:
    """Rank of every node's least audit, by audits of 1, 2, 4, ... letters (a shorter one first)."""
    nodes = len(to)
    has = to >= 0
    step = np.where(has.any(1), has.argmax(1), -1)          # the least letter
    at = np.where(step >= 0, to[np.arange(nodes), step], np.arange(nodes))
    rank = np.unique(step, return_inverse=True)[1]
    while True:
        pair = rank * nodes + np.where(at != np.arange(nodes), rank[at], 0)
        finer = np.unique(pair, return_inverse=True)[1]
        further = at[at]
        if (further == at).all():
            return finer
        rank, at = finer, further


def least_path(to: np.ndarray, starts: list[int]) -> list[tuple[str, int]]:
    """(least audit, last node) from each start, by ranks and doubled pointers."""
    nodes = len(to)
    rank = rank_paths(to)
    key = np.where(to >= 0, np.arange(4) * nodes + rank[to], 5 * nodes)
    step = np.where((to >= 0).any(1), key.argmin(1), -1)
    at = np.where(step >= 0, to[np.arange(nodes), step], np.arange(nodes))
    path = np.array(starts, np.int64).reshape(-1, 1)
    while (step[path[:, -1]] >= 0).any():                   # the first 2n nodes: n, and their images n letters on
        path = np.concatenate([path, at[path]], 1)
        at = at[at]
    length = (step[path] >= 0).sum(1)
    return [("".join(LETTERS[x] for x in step[p[:n]]), int(p[n])) for p, n in zip(path, length)]


def _least_paths(found: list[tuple]) -> list[dict]:
    """Per block of (targets, costs, entry states): {entry: (audit, exit)}. The blocks are ranked as one graph."""
    offsets = np.cumsum([0] + [len(to) for to, _, _ in found])
    joined = np.concatenate([np.where(to >= 0, to + o, -1) for (to, _, _), o in zip(found, offsets)])
    starts = [(k, q) for k, (_, cost, entries) in enumerate(found) for q in entries if cost[0][q] < INF]
    out: list[dict] = [{} for _ in found]
    for (k, q), (audit, node) in zip(starts, least_path(joined, [int(offsets[k]) + q for k, q in starts])):
        out[k][q] = (audit, int(node - offsets[k]) % 4)
    return out


def _block_paths(batches):
    """Blocks with the costs behind them to the least audit from each entry state, with its exit state."""
    for b in batches:
        found = []
        for symbols, behind, last, number in zip(*(b.column(c).to_pylist() for c in ("symbols", "behind", "last", "block"))):
            found.append((*optimal_arcs(symbols, behind, last), [0] if number == 0 else [0, 1, 2, 3]))
        # Short blocks are ranked together, long ones alone: paths of about one length share an array.
        short = [k for k, f in enumerate(found) if len(f[0]) <= 4 * SHORT]
        groups = [short[i:i + 1024] for i in range(0, len(short), 1024)]
        groups += [[k] for k, f in enumerate(found) if len(f[0]) > 4 * SHORT]
        paths: list[dict] = [{}] * len(found)
        for group in groups:
            for k, p in zip(group, _least_paths([found[k] for k in group])):
                paths[k] = p
        none = (None, None)
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("block"), b.column("g"),
             pa.array([[p.get(q, none)[0] for q in range(4)] for p in paths], pa.list_(pa.string())),
             pa.array([[p.get(q, none)[1] for q in range(4)] for p in paths], pa.list_(pa.int32())),
             pa.array([f[1][0][0] for f in found], pa.int64())],
            names=["conv_id", "block", "g", "audits", "exits", "cost"])


def _entered(batches):
    """Blocks sorted by (conv_id, block) with the state in which the path enters them."""
    conv, state = None, 0
    for b in batches:
        out = []
        for c, exits in zip(b.column("conv_id").to_pylist(), b.column("exits").to_pylist()):
            conv, state = c, state if c == conv else 0
            out.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(out, pa.int32())],
                                         names=["conv_id", "block", "entry"])


def repair_plan(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, g, entry, audit, cost): the cheapest edits of every block of rows; cost is the
    conversation's, in its first block; g is the number of the block's first row."""
    blocks = materialize(symbol_blocks(rows, block), "symbols")
    ends = blocks.groupBy("conv_id").agg(F.max("block").alias("last_block"))
    blocks = blocks.join(ends, "conv_id").withColumn("last", F.col("block") == F.col("last_block"))
    tables = blocks.where("last_block > 0").select("conv_id", "block", "symbols").mapInArrow(
        _cost_tables, "conv_id long, block long, table array<long>")
    behind = tables.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(
        _end_costs, "conv_id long, block long, behind array<long>")
    blocks = blocks.join(behind, ["conv_id", "block"], "left").withColumn(
        "behind", F.coalesce("behind", F.array(*[F.lit(c) for c in END_COSTS]).cast("array<long>")))
    paths = materialize(blocks.select("conv_id", "block", "g", "symbols", "behind", "last").mapInArrow(
        _block_paths, "conv_id long, block long, g long, audits array<string>, exits array<int>, cost long"), "blockpaths")
    entry = paths.select("conv_id", "block", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        _entered, "conv_id long, block long, entry int")
    return paths.join(entry, ["conv_id", "block"]).select(
        "conv_id", "block", "g", "entry", F.get("audits", F.col("entry")).alias("audit"),
        F.when(F.col("block") == 0, F.col("cost")).alias("cost"))


# ---------------------------------------------------------------- repaired text
def applied(audit: str, entry: int):
    """Edits of a block in order: (letter, the row's state before it)."""
    state = entry
    for letter in audit:
        symbol = yield letter, state
        if letter == "K":
            state = AFTER_KEEP[state][symbol]
        elif letter != "D":
            state = AFTER_NEW[state]


def _digests(batches):
    """Edits and rows sorted by (conv_id, g, edits before rows) to the repaired text's digest."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, audit, sha, some, edits, now = None, [], None, False, None, None

    def write(role: str, text: str):
        nonlocal some
        sha.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
        some = True

    def inserts():
        """Write inserted rows up to the next edit of a row (None at the end of the block)."""
        nonlocal now
        while now is not None and now[0] == "I":
            write(NEW_ROLE[now[1]], "")
            now = next(edits, None)

    for b in batches:
        done = []
        for c, piece, entry, symbol, role, text in zip(*(b.column(x).to_pylist() for x in (
                "conv_id", "audit", "entry", "symbol", "role", "text"))):
            if c != conv:
                if conv is not None:
                    done.append((conv, "".join(audit), sha.hexdigest()))
                conv, audit, sha, some = c, [], hashlib.sha256(), False
            if piece is not None:
                audit.append(piece)
                edits = applied(piece, entry)
                now = next(edits, None)
                inserts()
                continue
            letter, state = now
            if letter != "D":
                write(role if letter == "K" else NEW_ROLE[state], text)
            try:
                now = edits.send(symbol)
            except StopIteration:
                now = None
            inserts()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
    if conv is not None:
        last = (conv, "".join(audit), sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, schema)], schema=schema)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation with rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    ordered = ordered_rows(rows)
    rows = faults(ordered)
    plan = materialize(repair_plan(rows, block), "plan")
    none = F.lit(None)
    edits = plan.select("conv_id", "g", F.lit(0).alias("kind"), "audit", "entry", none.cast("int").alias("symbol"),
                        none.cast("string").alias("role"), none.cast("string").alias("text"))
    told = ordered.select("conv_id", "g", F.lit(1).alias("kind"), none.cast("string").alias("audit"),
                          none.cast("int").alias("entry"), "symbol", "role", "text")
    both = edits.unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "g", "kind")
    digests = both.mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")

    turns = rows.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f)
                                                  for f in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("conv_id").agg(
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    # A row's neighbour is in its block or the next one's first row, which is copied back.
    near = rows.select("conv_id", F.floor(F.col("pos") / block).alias("block"), "pos", "symbol", F.lit(False).alias("halo"))
    halo = near.where((F.col("pos") % block == 0) & (F.col("pos") > 0)).withColumn("block", F.col("block") - 1).withColumn(
        "halo", F.lit(True))
    w = Window.partitionBy("conv_id", "block").orderBy("pos")
    pair = F.concat(F.col("symbol").cast("string"), F.lead("symbol").over(w).cast("string"))
    pairs = near.unionByName(halo).withColumn("pair", pair).where("NOT halo")
    illegal = pairs.groupBy("conv_id").agg(F.count_if(~F.col("pair").isin("01", "12", "21")).alias("illegal"))
    cost = plan.where("block = 0").select("conv_id", "cost")
    return counts.join(illegal, "conv_id").join(cost, "conv_id").join(digests, "conv_id").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``repair`` of the damaged rows, for every conversation of ``conversations``."""
    ids = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    r = ids.join(repair(damaged(conversations), block), "conv_id", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return r.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
