"""Cases in which an operator once did less than the whole job."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from headway.llm import lm, tokenfile, urlrules

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r[0]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("bits", [1, 1 << 22])
def test_filter_above_the_broadcast_size_keeps_every_bigram(spark, bits):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = (by_id(lm.score_texts(d, params=lm.LMParams(max_filter_bits=x, run_tokens=5000, group_tokens=9000)))
            for x in (1 << 28, bits))
    assert a.keys() == b.keys()
    for k in a:
        assert {**b[k], "score": 0, "base_score": 0} == {**a[k], "score": 0, "base_score": 0}
        assert b[k]["base_score"] == pytest.approx(a[k]["base_score"], rel=1e-9)
        assert b[k]["score"] == pytest.approx(a[k]["score"], rel=1e-9)


def test_bigrams_seen_once_are_stored(spark):
    words = [f"w{i}" for i in range(200)]
    d = spark.createDataFrame([(i, " ".join(words[i::7])) for i in range(7)], "doc_id long, text string")
    got, two = (by_id(lm.score_texts(d, params=p)) for p in (lm.LMParams(), lm.LMParams(min_bigram=2)))
    trained = [k for k in got if not got[k]["held_out"]]
    assert trained and all(got[k]["score"] > two[k]["score"] + 5 for k in trained)


def test_a_rule_holds_for_every_token_of_the_same_labelled_urls(spark):
    """Labelled URLs have the twins together; others have the host alone, the path alone, or neither."""
    urls = [(i, f"http://casino.example/bonus/{i}" if i < 60 else f"http://a.org/x/{i}") for i in range(120)]
    more = [(1000, "http://other.example/bonus/y"), (1001, "http://casino.test/z"), (1002, "http://other.example/y")]
    pages = spark.createDataFrame(urls + more, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i, _ in urls], "doc_id long, quality int")
    judged = urlrules.judge_urls(pages, labels, rules=(), params=urlrules.RuleParams(0.05, 10, 0.9)).collect()
    blocked = {r.page_id for r in judged if r.verdict == "block"}
    assert len(judged) == 123 and blocked >= set(range(60)) | {1000, 1001}
    assert not blocked & set(range(60, 120))


def test_numbers_are_tokens(spark):
    """Bad URLs marked by a section of digits alone; page numbers are too rare for rules."""
    urls = [(i, f"http://a.org/888/{i}" if i < 100 else f"http://a.org/{i}/x") for i in range(300)]
    pages = spark.createDataFrame(urls + [(1000, "http://b.net/888/q"), (1001, "http://b.net/7/q")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in urls], "doc_id long, quality int")
    judged = urlrules.judge_urls(pages, labels, rules=()).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == {*range(100), 1000}


def test_every_token_of_a_rule_may_be_a_twin(spark):
    """Bad only where two classes meet; the unlabelled URL has the second member of each."""
    part = lambda i: ("spam/deal" if i % 2 else "good/news") + "/" + ("win/prize" if i % 4 < 2 else "lose/none")
    urls = [(i, f"http://a.org/{part(i)}/{i}") for i in range(200)]
    more = [(1000, "http://b.org/spam/win"), (1001, "http://b.org/deal/prize"), (1002, "http://b.org/spam/deal")]
    pages = spark.createDataFrame(urls + more, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not (i % 2 and i % 4 < 2))) for i, _ in urls], "doc_id long, quality int")
    judged = urlrules.judge_urls(pages, labels, rules=(), params=urlrules.RuleParams(0.05, 10, 0.9)).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == {
        i for i in range(200) if i % 2 and i % 4 < 2} | {1000, 1001}


@pytest.mark.parametrize("pair", ["J̌", "H̱", "T̈", "W̊", "Y̊"])
def test_capitals_composed_in_lower_case_only(pair):
    path = P.path("word_bpe_49k.json")
    texts = [pair, f"Plain text. Then {pair}an, and More.", "Plain text. Then more"]
    ids, counts = tokenfile.encode_batch(pa.array(texts), path)
    tok = Tokenizer.from_file(path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [
        tok.encode(t, add_special_tokens=False).ids for t in texts]
