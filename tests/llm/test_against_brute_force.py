"""Every query that SQL cannot express, against a plain Python version on the small driver tables."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from headway.llm import bpe, lm, queries, sharding

SF = "/root/testdata/sf0.001"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(df):
    return {r[0]: r.asDict() for r in df.collect()}


def test_token_file(spark, docs):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, start = rows(queries.op5_token_file(spark, SF)), 0
    assert len(got) == len(docs)
    for doc_id, text, _ in sorted(docs):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert got[doc_id] == {"doc_id": doc_id, "start": start, "n_tokens": len(ids),
                               "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def test_byte_bpe(spark, docs):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(queries.op6_byte_bpe(spark, SF))
    assert len(got) == len(docs)
    for doc_id, text, _ in docs:
        ids = np.array(enc.encode_ordinary(text), "<u4")
        assert got[doc_id] == {"doc_id": doc_id, "n_tokens": len(ids),
                               "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
                               "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}


def plain_features(text):
    words = SPACE_WORDS.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_features(spark, docs):
    got = rows(queries.op7_quality_rules(spark, SF))
    assert len(got) == len(docs)
    for doc_id, text, _ in docs:
        f = plain_features(text)
        assert {k: got[doc_id][k] for k in f} == f
        failed = f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        assert got[doc_id]["base_failed"] == failed
        assert not (failed and got[doc_id]["kept"])


def test_base_score_and_counts(spark, docs):
    got = rows(queries.op8_bloom_lm(spark, SF))
    tokens = {d: SPACE_WORDS.findall(t.translate(UP)) + [None] for d, t, _ in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    better = 0
    for d, ws in tokens.items():
        g = got[d]
        assert (g["held_out"], g["n_tokens"], g["train_tokens"]) == (held[d], len(ws), n)
        assert g["n_known"] == sum(c[w] > 0 for w in ws)
        assert g["base_score"] == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert g["score"] < 0
        better += g["score"] > g["base_score"]
    assert better > 0


@pytest.mark.parametrize("bits", [1 << 28, 1])
def test_counts_are_exact_however_tokens_are_dealt(spark, bits):
    """Small runs and groups, with contexts that several groups share: counts and base stay exact."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = rows(lm.score_texts(d))
    b = rows(lm.score_texts(d, params=lm.LMParams(max_filter_bits=bits, run_tokens=3000, group_tokens=4000)))
    apart = [b[k]["score"] - a[k]["score"] for k in a]
    for k in a:
        assert a[k]["n_known"] == b[k]["n_known"]
        assert a[k]["base_score"] == pytest.approx(b[k]["base_score"], rel=1e-9)
    assert abs(sum(apart)) < 0.01 * sum(x["n_tokens"] for x in a.values())


def test_score_is_near_the_exact_interpolated_model(spark, docs):
    """Against exact counts: within 0.02 log10 a token over all texts, and 0.1 for a text of 100 tokens or more."""
    got = rows(lm.score_texts(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")))
    tokens = {d: SPACE_WORDS.findall(t.translate(UP)) + [None] for d, t, _ in docs}
    one, two, followers = Counter(), Counter(), Counter()
    for d, ws in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            one.update(ws)
            two.update(zip(["begin mark"] + ws[:-1], ws))
    texts = sum(zlib.crc32(str(d).encode()) % 7 != 2 for d in tokens)
    followers.update(v for v, _ in two)
    n, types = sum(one.values()), len(one)

    def exact(ws):
        total = 0.0
        for v, w in zip(["begin mark"] + ws[:-1], ws):
            c_v = max(texts if v == "begin mark" else one[v], 1)
            mass = min((c_v - lm.DISCOUNT * followers[v]) / c_v if followers[v] else 0.0, 0.95)
            seen = min(max(two[v, w] - lm.DISCOUNT, 0) / c_v, mass)
            total += log10(seen + (1 - mass) * min((one[w] + 1) / (n + types + 1), 1.0))
        return total
    apart = {d: (got[d]["score"] - exact(ws), len(ws)) for d, ws in tokens.items()}
    assert abs(sum(x for x, _ in apart.values())) < 0.02 * sum(k for _, k in apart.values())
    assert all(abs(x) < 0.1 * k for x, k in apart.values() if k >= 100)


def plain_fingerprint(text):
    words = SPACE_WORDS.findall(text.translate(UP))
    k = min(3, len(words))
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    got = rows(queries.op9_simhash(spark, SF))
    fps = {d: plain_fingerprint(t) for d, t, _ in docs}
    want = plain_components(fps)
    assert {d: (g["fingerprint"], g["component_id"]) for d, g in got.items()} == {
        d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_shards(spark, docs):
    got = queries.op10_feistel_shards(spark, SF).collect()
    n, order = len(docs), sorted(docs)
    where = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in got}
    for row_no, (doc_id, text, _) in enumerate(order):
        raw = text.encode()
        assert where[doc_id] == (len(raw) + 1, zlib.crc32(raw), *sharding.place(row_no, n))
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - n / 8) < 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op1_toxicity_fm(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    clean = [p for t, p in held if t == 0]
    toxic = [p for t, p in held if t == 1]
    assert sum(clean) <= 0.05 * len(clean)
    assert sum(toxic) >= 0.5 * len(toxic)


def host_path(url):
    if "://" not in (url or ""):
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m[1].translate(UP), m[2]


def test_url_rules(spark):
    got = queries.op4_url_rules(spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
    for r in got:
        host, path = host_path(urls[r.page_id])
        fits = [(len(h + p), h + p, v) for v, h, p in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        if fits:
            assert (r.rule, r.verdict) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict in ("allow", "block")
    assert len(got) == len(urls)
