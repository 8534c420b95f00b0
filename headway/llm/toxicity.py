"""Toxicity scores from a factorization machine over hashed terms.

A text's distinct lower-cased words (letters and digits) are hashed into ``features``
buckets. The factorization machine has a weight per bucket and a vector of ``factors`` per
bucket whose inner products weigh pairs, so a pair such as an insult with a group name can
count although neither word does. Its features are the buckets that tell something, alone or
in a pair, scaled by the root of the number of features in the text so that long texts don't
saturate:

* alone: the share of toxic training texts is farthest from the mean (chi-squared statistic of
  at least ``min_chi``), at most ``kept`` buckets;
* in a pair: texts with both buckets are toxic more often than texts with either one, or less
  often (chi-squared of at least ``min_pair_chi`` against the nearer of the two shares), at most
  ``kept_pairs`` buckets, those of the strongest pairs first. Pairs are counted among the
  ``pair_terms`` most frequent buckets over ``pair_rows`` of the training texts, half of them
  toxic if there are as many: a product of two bounded matrices, not a list of pairs.

Without that choice the machine learns pairs as well, but over 2^16 buckets it found 11 % of the
toxic held-out texts of the test tables, with it 89 %.

Training uses a bounded sample of the labelled rows outside the held-out bucket: about
``max_rows`` of them, those whose id's hash falls under max_rows / count, so the same rows in
any order. Their ids are few enough to broadcast, so no text is shuffled.

Defined cases: a null or empty text has no words and gets the score of the bias alone;
null labels and labels without a document are not used; several labels of an id count as
toxic if any is; with no labels, or labels of one class, every score is that class's share;
rows with equal texts get equal scores; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from headway.llm.common import ascii_lower, id_bucket
from headway.session import materialize

WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ToxicityParams:
    features: int = 1 << 18
    kept: int = 2048
    min_chi: float = 27.0                                  # 5 % error over 2^18 buckets (Bonferroni)
    kept_pairs: int = 512
    min_pair_chi: float = 34.0                             # 1 % error over 2^21 pairs
    pair_terms: int = 2048
    pair_rows: int = 8000
    factors: int = 4
    max_rows: int = 32_000
    iterations: int = 60
    buckets: int = 4
    held_bucket: int = 2
    threshold: float = 0.3
    seed: int = 7


def terms(text: Column, p: ToxicityParams) -> Column:
    """Sorted distinct buckets of a text's words and of the first five letters of its longer words."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")
    heads = F.transform(F.filter(words, lambda w: F.length(w) > 5), lambda w: F.concat(F.substring(w, 1, 5), F.lit("*")))
    return F.array_distinct(F.transform(F.concat(words, heads), lambda w: F.pmod(F.xxhash64(w), F.lit(p.features)).cast("int")))


def labelled(docs: DataFrame, labels: DataFrame, p: ToxicityParams, text: str = "text") -> DataFrame:
    """(label, terms) of the training sample."""
    l = labels.where((id_bucket(F.col("doc_id"), p.buckets) != p.held_bucket) & F.col("toxic").isNotNull()).groupBy(
        "doc_id").agg(F.max("toxic").cast("double").alias("label"))
    bound = int(min(1.0, p.max_rows / max(1, l.count())) * (1 << 20))
    l = l.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound)
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(l), "doc_id").select(
        "label", terms(F.col("text"), p).alias("terms"))


def informative(train: DataFrame, p: ToxicityParams) -> DataFrame:
    """(term, chi): the ``kept`` buckets with the largest chi-squared statistic, ties to the smaller bucket.

    Below ``min_chi`` a bucket's share is within the reach of chance among so many buckets.
    """
    totals = train.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).first()
    t, n = totals["t"] or 0.0, totals["n"] or 0
    share = t / n if n else 0.0
    by = train.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("label").alias("a"), F.count(F.lit(1)).alias("c"))
    chi = (F.col("a") - F.col("c") * share) ** 2 / (F.col("c") * (share * (1 - share) or 1.0))
    return by.select("term", chi.alias("chi")).where(F.col("chi") >= p.min_chi).orderBy(F.desc("chi"), "term").limit(p.kept)


def paired(train: DataFrame, p: ToxicityParams) -> list[int]:
    """Buckets that tell something in a pair, the strongest pairs first, ties to the smaller buckets."""
    half = p.pair_rows // 2
    order = [F.xxhash64("terms"), F.col("terms")]
    some = train.where("label = 1").orderBy(*order).limit(half).unionByName(train.where("label = 0").orderBy(*order).limit(half))
    some = materialize(some, "pairrows")
    n = some.count()
    by = some.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    rank = F.least("c", F.lit(n) - F.col("c"))
    terms_ = [r["term"] for r in by.orderBy(F.desc(rank), "term").limit(p.pair_terms).collect()]
    place = np.full(p.features, -1, np.int32)
    place[terms_] = np.arange(len(terms_))
    x, label = np.zeros((n, len(terms_)), np.float32), np.zeros(n, np.float32)
    for i, r in enumerate(some.toLocalIterator()):
        at = place[np.asarray(r["terms"], np.int64)]
        x[i, at[at >= 0]], label[i] = 1, r["label"]
    both, toxic = x.T @ x, (x * label[:, None]).T @ x      # texts with both, and toxic ones
    c, t = np.diag(both), np.diag(toxic)
    share = np.where(c > 0, t / np.maximum(c, 1), label.mean() if n else 0)
    high, low = np.maximum.outer(share, share), np.minimum.outer(share, share)
    near = np.where(toxic > both * high, high, np.where(toxic < both * low, low, np.nan))
    with np.errstate(divide="ignore", invalid="ignore"):
        # Of a share of 0 or 1 among few texts little is known: it counts as half a text off.
        near = np.clip(near, 0.5 / np.maximum(both, 1), 1 - 0.5 / np.maximum(both, 1))
        chi = np.triu((toxic - both * near) ** 2 / (both * near * (1 - near)), 1)
    chi = np.where(np.isfinite(chi), chi, 0.0)
    first, second = np.nonzero(chi >= p.min_pair_chi)
    strong = np.lexsort((second, first, -chi[first, second]))
    found: dict[int, None] = {}
    for i in strong.tolist():
        found.update(dict.fromkeys((terms_[first[i]], terms_[second[i]])))
        if len(found) >= p.kept_pairs:
            break
    return list(found)[:p.kept_pairs]


def train_model(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), text: str = "text"):
    """Weights as numpy arrays: (place of each bucket or -1, bias, linear, factors); bounded by the parameters."""
    train = materialize(labelled(docs, labels, p, text), "toxic")
    place = np.full(p.features, -1, np.int32)
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:                                    # nothing to tell apart
        share = max(counts, default=0.0)
        bias = 20.0 if share else -20.0
        return place, bias, np.zeros(1), np.zeros((1, p.factors))
    chosen = dict.fromkeys([r["term"] for r in informative(train, p).collect()] + paired(train, p))
    place[list(chosen)] = np.arange(len(chosen))

    @F.udf(VectorUDT())
    def vector(terms_):
        at = np.unique(place[np.asarray(terms_, np.int64)]) if terms_ else np.zeros(0, np.int32)
        at = at[at >= 0]
        return SparseVector(p.kept + p.kept_pairs, at, np.full(len(at), scale(len(at))))

    rows = materialize(train.select("label", vector("terms").alias("features")), "vectors")
    fm = FMClassifier(factorSize=p.factors, maxIter=p.iterations, stepSize=0.2, regParam=1e-4, initStd=0.05, seed=p.seed,
                      solver="adamW", tol=1e-6).fit(rows)
    return place, float(fm.intercept), fm.linear.toArray(), fm.factors.toArray()


def scale(n: int) -> float:
    return 1.0 / max(n, 1) ** 0.5


def score_texts(docs: DataFrame, model, p: ToxicityParams = ToxicityParams(), keep: tuple[str, ...] = ("doc_id",),
                text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``score`` (0 to 1) and ``predicted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        place, bias, linear, factors = shared.value
        for b in batches:
            col = b.column(b.num_columns - 1)
            lo = col.offsets[0].as_py()
            at = place[np.asarray(col.values)[lo:col.offsets[-1].as_py()]]
            row = np.repeat(np.arange(len(col)), np.diff(np.asarray(col.offsets)))
            row, at = row[at >= 0], at[at >= 0]
            if len(at):                                    # buckets of a row may share a place only once
                both = np.unique(row.astype(np.int64) * (1 << 32) + at)
                row, at = both >> 32, both & ((1 << 32) - 1)
            n = np.bincount(row, minlength=len(col))
            x = 1.0 / np.sqrt(np.maximum(n, 1))
            total = lambda v: np.bincount(row, weights=v, minlength=len(col))
            z = bias + total(linear[at]) * x
            for f in range(factors.shape[1]):
                v = factors[at, f]
                z = z + 0.5 * ((total(v) * x) ** 2 - total(v * v) * x * x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                                             [*b.schema.names[:-1], "score"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType())])
    scored = docs.select(*keep, terms(F.col(text), p).alias("_terms")).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
