"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every query."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from headway.llm import bpe, chat, decontam, lm, queries, quality, sharding, simhash, tokenfile
from headway.session import materialize
from tests.llm.test_against_brute_force import plain_components, plain_features, plain_fingerprint

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]
PASSAGE = " ".join(f"bench{i}" for i in range(30))
CLEAN = [" ".join(random.choices([w + str(i) for w in WORDS for i in range(40)], k=80)) for _ in range(12)]
TEXTS = [None, "", "   \n\t ", "one", "two words", "İstanbul ẞ 'S don't  <|endoftext|> 🙂", CLEAN[0], CLEAN[0],
         "x" * 70_000, " ".join(CLEAN[1:4] * 60), CLEAN[5] + " " + PASSAGE, PASSAGE, "BENCH3 bench4, bench5!", *CLEAN]
DOCS = [(i if i != 6 else None, t, "en" if i % 3 else None) for i, t in enumerate(TEXTS)] + [(7, CLEAN[0], "en")] * 2
DOC_SCHEMA = "doc_id long, text string, lang string, n_words int, score double, k1 string, items int, w int, fp int, source string"


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    tables = {
        "documents": (DOC_SCHEMA, [(*d, 1, 0.5, "k", 2, 3, 4, "s") for d in DOCS]),
        "labels": ("doc_id long, quality int, toxic int, text string",
                   [(i, int(i % 4 > 0), int(i % 5 == 0), "t") for i in range(25)] + [(3, 1, 0, "t"), (None, 1, 1, "t"), (4, None, None, "t")]),
        "benchmark": ("item_id long, text string, n_words int",
                      [(1, PASSAGE, 1), (1, PASSAGE, 1), (2, "bench3 BENCH4 bench5", 1), (3, None, 1), (4, "", 1), (None, "gone words here", 1)]),
        "pages": ("page_id long, url string, host string, html string",
                  [(1, None, "h", "x"), (2, "no scheme", "h", "x"), (3, "http://", "h", "x"), (4, "HTTP://WWW.Example.COM/en/x?q#f", "h", "x"),
                   (4, "HTTP://WWW.Example.COM/en/x?q#f", "h", "x"), (None, "http://a.net/es/", "h", "x"), (5, "http://net/fr/1", "h", "x"),
                   (6, "http://xnet/fr/1", "h", "x"), (7, "http://example.com?/en/", "h", "x")]),
        "conversations": ("conv_id long, turn long, role string, text string, parts int",
                          [(1, 0, "user", None, 1), (1, 1, "assistant", "a\\|b <|im_end|>\\n", 1), (1, 1, "assistant", "a\\|b <|im_end|>\\n", 1),
                           (None, 0, None, "x", 1), (2, None, "assistant", "", 1), (2, 5, "us\ner", "q" * 50_000, 1)]),
    }
    for name, (schema, rows) in tables.items():
        df = spark.createDataFrame(rows, schema)
        df.coalesce(2).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


def got(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def expected(make):
    return sorted(({"doc_id": d, **make(t or "")} for d, t, _ in DOCS), key=str)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op3_chat_format"])
def test_empty_tables(spark, dirs, name):
    assert queries.QUERIES[name](spark, dirs[1]).count() == 0


def test_empty_conversations_leave_the_probe(spark, dirs):
    assert [r.conv_id for r in queries.op3_chat_format(spark, dirs[1]).collect()] == [-1]


def test_empty_pipeline(spark, dirs):
    assert corpus_pipeline.run(spark, dirs[1]).count() == 0


def test_decontamination(spark, dirs):
    rows = {(r.doc_id, r.n_words): r for r in queries.op2_decontam_index(spark, dirs[0]).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert queries.op2_decontam_index(spark, dirs[0]).count() == len(DOCS)
    r = rows[11, 30]
    assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (30, 2, digest("1,2"), True)
    r = rows[12, 3]
    assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (3, 1, digest("2"), True)
    r = rows[10, 110]
    assert (r.n_hit, r.contaminated) == (30, True)
    r = rows[0, 0]
    assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (0, 0, digest(""), False)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red q green blue x x x x x x x red"), (2, "blue green red"), (3, "red green")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id int, text string")
    wanted = decontam.phrases(items)
    terms = wanted.select(F.explode("phrase").alias("term")).distinct()
    anchored = decontam.anchored(wanted, decontam.term_counts(docs, terms))
    index = decontam.build_index(docs, anchored.select(F.col("anchor").alias("term")).distinct(), 4)
    near = lambda slop: decontam.proximity_matches(index, anchored, slop).count()
    assert decontam.phrase_matches(index, anchored).count() == 0
    assert (near(0), near(1)) == (1, 2)


def test_chat(spark, dirs):
    rows = {r.conv_id: r for r in queries.op3_chat_format(spark, dirs[0]).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "a\\|b <|im_end|>\\n"
    assert rows[1].turns_sha256 == sha(f"user\n\nassistant\n{said}\nassistant\n{said}\n")
    assert (rows[1].loss_chars, rows[1].loss_sha256) == (2 * len(said), sha(said * 2))
    assert rows[2].turns_sha256 == sha("assistant\n\nus\ner\n" + "q" * 50_000 + "\n")
    assert rows[None].n_turns == 1 and rows[-1].n_turns == 2 and len(rows) == 4


def test_typed_parts(spark):
    parts = [("text", "see | this", None, None), ("image", None, "s3://a.png", 256.0), ("audio", None, "b.wav", 1.5),
             ("document", None, None, -1.0), ("other", "o", None, None)]
    df = spark.createDataFrame([(1, 3, "user", parts), (1, 4, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    role, content = chat.parse_turn(first.formatted)
    assert (role, content) == ("user", "see | this<|image:3.1|><|audio:3.2|><|document:3.3|>o")
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "s3://a.png", 256), ("audio", "b.wav", 38), ("document", None, 0)]
    assert all(first.formatted[a.offset:].startswith(f"<|{a.kind}") for a in first.attachments)
    assert first.n_attachment_tokens == 294 and (second.mask_length, second.attachments) == (0, [])


def test_urls(spark, dirs):
    rows = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op4_url_rules(spark, dirs[0]).collect()]
    assert sorted(rows, key=str) == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (None, "a.net", "/es/", "net/es/", "block"), (5, "net", "/fr/1", "net/fr/", "block"),
        (6, "xnet", "/fr/1", None, "allow"), (7, "example.com", "", None, "allow")], key=str)


def test_tokens_of_the_same_urls_are_mined_once(spark):
    """Copies of a URL with thirty tokens of their own would have 2^30 itemsets."""
    from headway.llm import urlrules
    long = "/".join(f"w{i}" for i in range(30))
    urls = [(i, f"http://a.org/{long}/{i}" if i < 60 else f"http://a.org/x/{i}") for i in range(120)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i, _ in urls], "doc_id long, quality int")
    params = urlrules.RuleParams(0.05, 10, 0.9)
    found = [r.tokens for r in urlrules.mine_rules(pages, labels, params).collect()]
    assert found == [["p:w0"]]
    judged = urlrules.judge_urls(pages, labels, rules=(), params=params).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == set(range(60))


def test_mined_url_rules(spark):
    """Bad only where two tokens meet: the pair is mined, its parts are not."""
    from headway.llm import urlrules
    urls = [(i, f"http://{'spam' if i % 2 else 'good'}.org/{'win' if i % 4 < 2 else 'lose'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not ("spam" in u and "win" in u))) for i, u in urls], "doc_id long, quality int")
    judged = urlrules.judge_urls(pages, labels, rules=(), params=urlrules.RuleParams(0.05, 10, 0.9)).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == {i for i, u in urls if "spam" in u and "win" in u}


def test_token_files(spark, dirs):
    tok, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for d, t, _ in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    rows = [tuple(r) for r in queries.op5_token_file(spark, dirs[0]).collect()]
    assert sorted(rows, key=lambda r: r[1]) == want       # ties are repeated rows here


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 3000])
@pytest.mark.parametrize("top", [2, 300, 49407, 1 << 31, (1 << 64) - 1])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    words, at = tokenfile.pack(ids)
    assert (tokenfile.unpack(words, at, n) == ids).all()


def test_byte_bpe(spark, dirs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})

    def make(t):
        ids = np.array(enc.encode_ordinary(t), "<u4")
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
                "decoded_sha256": hashlib.sha256(t.encode()).hexdigest()}
    assert got(queries.op6_byte_bpe(spark, dirs[0])) == expected(make)


def test_pieces_of_odd_texts():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    ours, enc = bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = ["a", "'", "'", "s", "re", "ll", " ", " ", "\n", "1", "٣", "é", "漢", "🙂", "!", "　", "\x85", "\x1c"]
    for _ in range(300):
        texts = ["".join(random.choices(some, k=random.randint(0, 40))) for _ in range(5)]
        ids, counts = ours.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == enc.encode_ordinary_batch(texts)
        assert ours.decode(ids) == "".join(texts).encode()


def test_cut_segments_have_the_same_pieces(monkeypatch):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    ours, text = bpe.Encoder(ranks), ("It's  a 'tale'\n\n of two　 cities, 12 years' " * 50).encode()
    whole = bpe._encode_rows(ours, [text])[0].tolist()
    parts = bpe.segments(text, 40)
    assert len(parts) > 5 and b"".join(parts) == text
    assert [i for p in parts for i in bpe._encode_rows(ours, [p])[0].tolist()] == whole


def test_quality(spark, dirs):
    rows = [{k: v for k, v in r.items() if k not in ("base_failed", "kept")} for r in got(queries.op7_quality_rules(spark, dirs[0]))]
    assert sorted(rows, key=str) == expected(plain_features)


def test_binomial_bound_is_exact(spark):
    from fractions import Fraction
    from math import comb, log
    df = spark.createDataFrame([(k, n) for n in (1, 7, 50, 400) for k in range(0, max(1, n // 20) + 1)], "k long, n long")
    p = Fraction(1, 20)
    for r in df.select("k", "n", quality.log_binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("x")).collect():
        if r.k <= r.n * 0.05:
            exact = sum(comb(r.n, i) * p ** i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert r.x == pytest.approx(log(exact), abs=1e-9)


def test_cutoffs_respect_the_bound(spark):
    """A rule is used only where the labels prove that few good documents are lost."""
    rows = [("big", "duplicate_lines", j, c, 5000, 5 if j < 4 else 4000, 300 if j > 1 else 0, 400) for j, c in enumerate(quality.GRID)]
    rows += [("small", r, j, c, 20, 0, 5, 5) for r in quality.RULES for j, c in enumerate(quality.GRID)]
    counts = spark.createDataFrame(rows, "stratum string, rule string, step int, cutoff double, n_good long, k_good long, k_bad long, n_bad long")
    chosen = quality.choose_cutoffs(counts, quality.RiskParams()).where("chosen").collect()
    assert [(r.stratum, r.rule, r.step) for r in chosen] == [("big", "duplicate_lines", 2)]


def test_language_model(spark, dirs):
    rows = queries.op8_bloom_lm(spark, dirs[0]).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r.score < 0 and r.base_score < 0 and 0 <= r.n_known <= r.n_tokens
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert not any(r.held_out for r in rows if r.doc_id is None)


def test_filter_levels():
    q = lm.level(np.array([0.0, 1, 1.4, 1.5, 2, 1000]))
    assert q.tolist() == [0, 1, 1, 2, 2, 18]
    assert (lm.level(lm.count_of(np.arange(1, 60))) == np.arange(1, 60)).all()


def test_simhash(spark, dirs):
    rows = queries.op9_simhash(spark, dirs[0]).collect()
    texts = {i: t for i, (_, t, _) in enumerate(DOCS)}
    fps = {i: plain_fingerprint(t or "") for i, t in texts.items()}
    root = plain_components(fps)
    least = {}
    for i, (d, _, _) in enumerate(DOCS):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    want = sorted(((d, f"{fps[i]:016x}", least.get(root[i])) for i, (d, _, _) in enumerate(DOCS)), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want


@pytest.mark.parametrize("hot", [2, 64])
def test_links_through_crowded_segments(spark, monkeypatch, hot):
    """Clusters that crowd a segment value give the same components as comparing all pairs."""
    monkeypatch.setattr(simhash, "HOT", hot)
    base, fps = random.getrandbits(64), set()
    for _ in range(150):
        x = base if random.random() < 0.7 else random.getrandbits(64)
        for b in random.sample(range(64), random.randint(0, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(dict(enumerate(fps)))
    groups, ours = {}, {}
    for i, x in enumerate(signed):
        groups.setdefault(want[i], set()).add(x)
        ours.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(41)}


def test_balls_are_not_broadcast(spark):
    """A ball holds some 35 rows of a fingerprint; the join must not trust the size of the fingerprints' file."""
    fps = materialize(spark.range(1000).select(F.xxhash64("id").alias("fp")), "fps")
    plan = simhash.link_fingerprints(fps)._jdf.queryExecution().sparkPlan().toString()
    inner = [x for x in plan.splitlines() if "Join" in x and "Inner" in x]
    assert len(inner) == 1 and "SortMergeJoin" in inner[0]


def test_shards(spark, dirs):
    rows = queries.op10_feistel_shards(spark, dirs[0]).collect()
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in DOCS)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_and_inverse(n):
    places = [sharding.permute(i, n, 11) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [sharding.row_at(p, n, 11) for p in places] == list(range(n))


def test_toxicity_without_labels_of_both_classes(spark, dirs):
    rows = queries.op1_toxicity_fm(spark, dirs[0]).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)


def test_pipeline_stages(spark, dirs):
    """Each stage keeps the columns of its input; decisions equal the operators'."""
    docs = spark.read.parquet(f"{dirs[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, dirs[0])
        assert out.schema == docs.schema, name
    kept = sorted((r.asDict() for r in corpus_pipeline.keep_quality(spark, docs, dirs[0]).select("doc_id", "text").collect()), key=str)
    fine = lambda f: not (f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"])
    assert kept == sorted(({"doc_id": d, "text": t} for d, t, _ in DOCS if fine(plain_features(t or ""))), key=str)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, dirs[0]).collect()
    fps = {i: plain_fingerprint(t or "") for i, (_, t, _) in enumerate(DOCS)}
    assert len(one) == len(set(plain_components(fps).values()))
    left = [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, dirs[0]).collect()]
    assert len(left) == len(DOCS) - 3 and not {10, 11, 12} & set(left)
