"""Conversation repair against a plain Python version, at several block sizes."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from headway.llm import queries, repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    """rows of one conversation in order: (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_best(rows, faults):
    """(cost, audit, repaired rows), by the best way to every state after every row."""
    best = {"": (0, "", ())}                                # state: "", s, u, a

    def put(to, q, way):
        if q not in to or way[:2] < to[q][:2]:
            to[q] = way

    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def insert(states):
        for _ in range(3):
            for q, (c, a, r) in list(states.items()):
                put(states, follow[q], (c + 3, a + "I", r + (f"{name[follow[q]]}:",)))

    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        after = {}
        for q, (c, a, r) in best.items():
            put(after, q, (c + 4, a + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 if fault else 0
            first = role[:1]
            if first == follow[q] or (first == "s" and q == ""):
                put(after, first, (c + late, a + "K", r + (f"{role}:{text}",)))
            put(after, follow[q], (c + late + 3, a + "R", r + (f"{name[follow[q]]}:{text}",)))
        best = after
    insert(best)
    return min(best[q] for q in ("", "a") if q in best)


def plain_repair(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    convs = defaultdict(list)
    for conv, turn, role, text in plain_damage(rows):
        convs[conv].append((turn, role, text))
    out = []
    for conv in ids:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        f = plain_faults(own)
        turns = {t for t, _, _ in own if t is not None}
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(own, own[1:])]
        cost, audit, lines = plain_best(own, f)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"),
                    f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed):
    r = random.Random(seed)
    rows = []
    for c in range(-5, 60):
        for t in range(r.choice([1, 2, 4, 9])):
            rows.append((c, r.choice([t, t, t, t + 3, None]), r.choice(["user", "assistant", "system", "tool", None, "", "User"]),
                         r.choice(["Fine.", "Is it? \n", "no end", "", None, " \t", "Ende!\x0b", "é", "🙂", "a.b", ". "])))
    rows += [(70, t, "user" if t % 2 else "assistant", f"turn {t}" + "." * (t % 5 > 0)) for t in range(300)]
    rows += [(71, 0, "user", "same.")] * 40 + [(72, None, None, None), (None, 0, "user", "nobody."), (73, 5, "system", "x" * 50_000 + ".")]
    r.shuffle(rows)
    return rows


def test_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, SF)) == plain_repair(rows)


@pytest.mark.parametrize("block", [repair.BLOCK, 3, 1])
def test_made_conversations_in_blocks(spark, block):
    rows = made(8)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.selectExpr("*", "1 AS pos", "'x' AS g", "2 AS block", "3 AS audit", "4 AS fault")
    assert got(repair.repair_damaged(df, block)) == plain_repair(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_damaged(df).count() == 0


def everything(roles, faults, most):
    """The least (cost, audit) of all edits with at most ``most`` inserted rows, by trying them all."""
    found = []
    for per_row in itertools.product("KRD", repeat=len(roles)):
        for gaps in itertools.product(range(3), repeat=len(roles) + 1):
            if sum(gaps) > most:
                continue
            slots = []                                      # (letter, allowed initials, cost)
            for i, g in enumerate(gaps):
                slots += [("I", "ua", 3)] * g
                if i < len(roles):
                    letter, late = per_row[i], 3 if faults[i] == "truncated" else 0
                    if letter != "D" and faults[i] in ("blank", "duplicate"):
                        break
                    slots.append({"K": ("K", roles[i], late), "R": ("R", "ua", 3 + late), "D": ("D", None, 4)}[letter])
            else:
                kept = [s[1] for s in slots if s[1]]
                if any(GRAMMAR.fullmatch("".join(x)) for x in itertools.product(*kept)):
                    found.append((sum(s[2] for s in slots), "".join(s[0] for s in slots)))
    return min(found)


def test_cheapest_and_least_among_all_edits():
    r = random.Random(2)
    code = {None: 0, "blank": 4, "truncated": 8}
    for _ in range(60):
        roles = [r.choice("suax") for _ in range(r.randrange(4))]
        faults = [r.choice([None, None, "blank", "truncated"]) for _ in roles]
        symbols = bytes("suax".index(x) + code[f] for x, f in zip(roles, faults))
        to, costs = repair.optimal_arcs(symbols, list(repair.END_COSTS), True)
        (audit, node), = repair.least_path(to, [0])
        assert (costs[0][0], audit) == everything(roles, faults, 4)
        assert node // 4 == len(roles) and node % 4 in (0, 3)


def test_ranks_order_the_least_audits():
    """The final ranks sort the nodes as the texts of their least audits do."""
    r = random.Random(6)
    symbols = bytes(r.choice([0, 1, 2, 3, 4, 9, 10]) for _ in range(40))
    to, costs = repair.optimal_arcs(symbols, list(repair.END_COSTS), True)
    nodes = [v for v in range(len(to)) if costs[v // 4][v % 4] < repair.INF]
    audits = [a for a, _ in repair.least_path(to, nodes)]
    rank = repair.rank_paths(to)
    by_text = np.unique(audits, return_inverse=True)[1]
    assert sorted(nodes, key=lambda v: (rank[v], v)) == [v for _, v in sorted(zip(by_text, nodes))]


def test_cost_tables_compose():
    """Costs behind a block from the tables of the blocks after it are those of one long block."""
    r = random.Random(9)
    symbols = bytes(r.choice([0, 1, 2, 3, 5, 9, 10]) for _ in range(50))
    whole = repair.block_costs(symbols, list(repair.END_COSTS))
    behind = list(repair.END_COSTS)
    for i in range(40, -1, -10):
        table = repair.cost_table(symbols[i:i + 10])
        behind = [min(table[4 * q + e] + behind[e] for e in range(4)) for q in range(4)]
        assert behind == whole[i]
