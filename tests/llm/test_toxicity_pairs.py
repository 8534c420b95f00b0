"""The factorization machine learns pairs whose words say nothing alone; scores against a plain version."""

import math
import random
import zlib

import pytest

from headway.llm import toxicity as T

NOISE = [f"w{i}" for i in range(300)]


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def agreeing(n=3000):
    """Toxic exactly when two words agree; each word is as often toxic as not."""
    r, rows = random.Random(1), []
    for i in range(n):
        a, b = r.randrange(2), r.randrange(2)
        words = r.choices(NOISE, k=12) + [f"aa{a}", f"bb{b}"]
        r.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    return rows


def mentioned(n=3000):
    """Toxic exactly when an ambiguous word meets a neutral mention."""
    r, rows = random.Random(2), []
    for i in range(n):
        a, b = r.random() < 0.3, r.random() < 0.3
        words = r.choices(NOISE, k=12) + ["ambiguous"] * a + ["mention"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    return rows


@pytest.mark.parametrize("make", [agreeing, mentioned])
def test_pairs_separate_held_out_texts(spark, make):
    rows = make()
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in T.score_texts(docs, T.train_model(docs, labels)).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 500
    assert sum(p for y, p in held if y) >= 0.95 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.05 * sum(1 - y for y, _ in held)


def test_words_without_a_say_are_not_chosen(spark):
    r = random.Random(3)
    docs, labels = tables(spark, [(i, " ".join(r.choices(NOISE, k=15)), i % 2) for i in range(2000)])
    train = T.labelled(docs, labels, T.ToxicityParams())
    assert len(T.paired(train, T.ToxicityParams())) <= 4


def test_scores_follow_from_the_weights(spark):
    """score = sigmoid(bias + sum w x + sum over pairs <v_i, v_j> x_i x_j), pair by pair."""
    rows = agreeing(400) + [(900, "", 0), (901, None, 0), (902, "only unknown words", 0), (903, "aa0 aa0 AA0 bb0", 1)]
    docs, labels = tables(spark, rows)
    p = T.ToxicityParams()
    model = place, bias, linear, factors = T.train_model(docs, labels, p)
    at = {r.doc_id: [] if r.t is None else r.t for r in docs.select("doc_id", T.terms(docs.text, p).alias("t")).collect()}
    for r in T.score_texts(docs, model, p).collect():
        x = sorted({int(place[b]) for b in at[r.doc_id] if place[b] >= 0})
        s = 1 / max(len(x), 1) ** 0.5
        z = bias + sum(linear[i] for i in x) * s
        z += sum(float(factors[i] @ factors[j]) for k, i in enumerate(x) for j in x[k + 1:]) * s * s
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_equal_texts_and_ties_get_equal_scores(spark):
    rows = agreeing(300) + [(1000 + i, "aa0 bb0 w1", 1) for i in range(3)]
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r.score for r in T.score_texts(docs, T.train_model(docs, labels)).collect()}
    assert got[1000] == got[1001] == got[1002]
