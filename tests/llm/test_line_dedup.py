"""Line dedup against a plain Python version, and its perfect hash and shards by themselves."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from headway.llm import linededup as L

OUTER = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
UP = {c: c + 32 for c in range(65, 91)}


def plain_dedup(rows, min_chars=10):
    holders = defaultdict(set)
    last = 2 ** 63
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[OUTER.sub("", line).translate(UP)].add(last if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(k := OUTER.sub("", x).translate(UP)) < min_chars
                or min(holders[k]) == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in L.line_digests(df).collect()), key=str)


def made(seed):
    r = random.Random(seed)
    pool = ["short", "", "   ", "exactly 10", "éàüéàüéàü", "éàüéàüéàüé", "A Longer Line Here", " a longer line here\t", "a longer line here\x0b",
            "a longer line here", " a longer line here", "ÀLONGER LINE OF TEXT", "àlonger line of text", "🙂🙂🙂🙂🙂🙂🙂🙂🙂🙂"]
    pool += [f"line number {i} of the pool" for i in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for i in range(-3, 60)]
    rows += [(5, rows[8][1]), (5, rows[8][1]), (7, "the other text of seven\nline number 1 of the pool"), (None, None), (None, "line number 2 of the pool\nonly null has this"),
             (None, "only null has this"), (100, None), (101, ""), (102, "\n".join(f"unique line {i}" for i in range(3000))), (103, "x" * 70_000), (104, "x" * 70_000)]
    rows += [(200 + i, "the very common line of a third of all rows\nand own text no " + str(i)) for i in range(120)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("max_hot,shard_lines", [(L.MAX_HOT, L.SHARD_LINES), (30, 100), (1, 7)])
def test_made_documents(spark, max_hot, shard_lines):
    rows = made(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.selectExpr("*", "1 AS hi", "'x' AS lo", "2 AS doc", "3 AS shard", "4 AS n_lines", "5 AS kept")
    assert got(L.dedup_lines(df, max_hot=max_hot, shard_lines=shard_lines)) == plain_dedup(rows)


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert got(L.dedup_lines(one)) == plain_dedup([(1, None)])


def test_perfect_hash_is_minimal_and_perfect():
    g = np.random.default_rng(4)
    hi, lo = (g.integers(0, 2 ** 63, 20_000).astype(np.uint64) for _ in range(2))
    h = L.PerfectHash.build(hi[:15_000], lo[:15_000])
    assert sorted(h.numbers(hi[:15_000], lo[:15_000])) == list(range(15_000)) and h.n == 15_000
    assert L.PerfectHash.build(hi[:0], lo[:0]).numbers(hi, lo).max() == -1
    with pytest.raises(ValueError):
        L.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


@pytest.mark.parametrize("width", [np.uint32, np.uint64])
def test_shard_answers_and_survives_packing(width):
    g = np.random.default_rng(5)
    hi, lo = (g.integers(0, 2 ** 63, 3000).astype(np.uint64) for _ in range(2))
    rows, least, shared = g.integers(1, 400, 1000), g.integers(0, 50, 1000), g.random(1000) < 0.3
    s = L.Shard.unpack(L.Shard.build(hi[:1000], lo[:1000], rows, least, shared, width).pack())
    doc = g.integers(0, 50, 3000)
    held, drop = s.dropped(hi, lo, doc)
    assert held[:1000].all() and not held[1000:].any()
    assert (drop[:1000] == (shared & (least != doc[:1000]))).all() and not drop[1000:].any()


def test_one_very_common_line_is_no_hot_shard(spark):
    """All documents share a line: it is answered by the broadcast shard, so no probe for it is shuffled."""
    rows = [(i, f"a line that all documents have\nown line number {i}") for i in range(500)]
    lines = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(L._doc_lines(10), "doc long, n long, hashes binary")
    index = L.line_index(lines, 4, 100).collect()
    hot = b"".join(bytes(r.hot) for r in index)
    assert len(hot) == 40
    e = np.frombuffer(hot, np.int64)
    assert e[2:].tolist() == [500, 0, 1]
