"""The prefix trie against a plain Python trie, its queue, and its shards at every split."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from headway.llm import queries, trie

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows, family=20):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        path = turns.get(base, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path)))
    out = []
    for node, who in members.items():
        below = [k for k in members if k[:len(node)] == node]
        children = [k for k in below if len(k) == len(node) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:len(k)] == k for x in members)]
        saved = sum((len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0) for k in below)
        ends = ",".join(map(str, sorted(c for c, n in who if n == len(node))))
        out.append((min(who)[0], len(node), min(members[node[:-1]])[0] if node else None, len(who), len(children),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(n, seed):
    """Conversations that share first turns, copies, a long one, nulls, ties and repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if c % 7 == 3:
            continue
        for t in range(r.choice([1, 2, 3, 5])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]),
                         r.choice(["a b", "c", "", None, "d e f", "a  b"])))
    rows += [(90, t, "user", "long one") for t in range(40)] + [(91, t, "user", "long one") for t in range(30)]
    rows += [(95, 0, "user", "same")] * 5 + [(None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(c, t, "user", "copy of all") for c in range(200, 230) for t in range(3)]
    r.shuffle(rows)
    return rows


def test_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_prefix_trie(spark, SF)) == plain_trie(rows)


@pytest.mark.parametrize("max_heavy,queue_limit", [(trie.MAX_HEAVY, trie.QUEUE_LIMIT), (8, 2), (1, 1)])
def test_made_conversations_at_every_split(spark, max_heavy, queue_limit):
    rows = made(60, 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.selectExpr("*", "1 AS depth", "'x' AS x1", "2 AS words", "3 AS g", "4 AS part", "5 AS n_convs")
    assert got(trie.prefix_trie(df, max_heavy=max_heavy, queue_limit=queue_limit)) == plain_trie(rows)


def test_no_rows_no_nodes(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(nobody).count() == 0


def test_a_conversation_without_turns_is_at_the_root(spark):
    # crc32("1") % 4 is 3, so conversation 1 loses its turns and its family's first one is absent.
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(trie.prefix_trie(df)) == plain_trie(rows)
    assert got(trie.prefix_trie(df))[0][1:4] == (0, None, 1)


def test_spilling_queue_sorts_whatever_spills():
    r = random.Random(3)
    items = [(r.randrange(50), r.randrange(50), i) for i in range(5000)]
    q = trie.SpillingQueue(limit=64, block=8)
    out, rest = [], list(items)
    while rest or q.peek() is not None:
        if rest and r.random() < 0.7:
            q.push(rest.pop())
        elif q.peek() is not None:
            out.append(q.pop())
    assert q.spilled > 10 and sorted(out) == sorted(items)
    for x in items:
        q.push(x)
    assert [q.pop() for _ in items] == sorted(items) and q.peek() is None


def test_a_long_conversation_is_no_single_task(spark):
    """Ranges cut a long conversation, also one of equal rows; prefixes go on across the cuts."""
    rows = [(1, t, "user", f"t{t}") for t in range(60)] + [(2, 0, "user", "x")] * 50 + [(c, 0, "user", "x") for c in range(3, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own, _ = trie._placed(df, 20)
        for conv in (1, 2):
            assert own.where(f"conv_id = {conv}").select("part").distinct().count() > 1
        assert got(trie.prefix_trie(df, max_heavy=20, queue_limit=3)) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
