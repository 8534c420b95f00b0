"""Language-model scoring with a log-frequency Bloom filter.

Tokenising happens once: a task turns about RUN_TOKENS tokens into a *run*, a row with its
documents, its different words (64-bit hashes) and its tokens as codes of them. One shuffle
then counts, inserts and asks: a run sends every *group* its words and different bigrams,
with their training counts, packed. A bigram (with a start mark before the first word and an
end token after the last) goes to the group of its context; the bigrams of frequent contexts,
fewer than 2 / share of them, are dealt by both words, so no context is one group's burden. A
group's task adds up the counts, inserts the entries into its part of the filter, and
answers the same runs. Nothing is stored but the answers.

The filter holds three kinds of entries: a word's count, a bigram's count (from
``min_bigram`` up: all of them), and a context's mass, the discounted bigram counts stored for
it. A count c is quantised to level q = 1 + floor(log c / log BASE), and the entry is inserted at
levels 1 .. q. A query probes level 1, 2, ... until one is missing: the last hit gives the
count. Each group has ``BITS_PER_ENTRY`` bits per insertion, so the filter grows with the
counted entries and nothing is thinned out.

Where the filter is probed: when it is sure to fit ``max_filter_bits`` (36 bits a training token
suffice), its parts are broadcast to the workers, which probe them for their runs. A larger one
is never in one place: a group's task probes its own part for the runs and sends the levels
back. Both give the same levels. The masses of frequent contexts, which several groups add to,
form a small part of their own that is broadcast in either case.

The smoothed probability interpolates by absolute discounting: with context v and word w,

    P(w | v) = max(c(vw) - D, 0) / c(v) + (1 - mass(v) / c(v)) * P1(w),

where mass(v) sums c(vw) - D over stored bigrams, so the weight of the second part is what
the stored bigrams leave, and P1(w) = (c(w) + 1) / (N + V + 1). All counts in it are what
the filter returns. The base score takes the exact word counts, which the groups answer as well.

Words and contexts are known by 64 bits of a hash, the second word of a bigram by 40 bits
within its context: of n different followers about n^2 / 2^41 pairs are taken for one.

Defined cases: a null or empty text is its end token; null ids are not held out (their
bucket is unknown) and train; no training rows give N = V = 0 and a base of 0 per token;
repeated rows count each time; a word of any length is one token; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from headway.llm.common import ascii_lower, id_bucket, split_words
from headway.session import materialize

BASE = 1.5
DISCOUNT = 0.75
BITS_PER_ENTRY = 12
HASHES = 3
WORD, BIGRAM, MASS = 1, 2, 3
#: Contexts with more than this share of the training tokens are always dealt by both words.
LEAST_SHARE = 2.0 ** -16
#: Most bits that a training token can need: a word, a context and a bigram insertion.
BITS_PER_TOKEN = 3 * BITS_PER_ENTRY
#: Tokens that no word can equal: words hold no space.
END, BEGIN = " end", " begin"


@dataclass(frozen=True)
class LMParams:
    """Bigrams are stored from ``min_bigram`` up; a filter that may need more than ``max_filter_bits`` is
    not broadcast; tokens of a run and (on average) of a group."""

    min_bigram: int = 1
    max_filter_bits: int = 1 << 28
    run_tokens: int = 1 << 21
    group_tokens: int = 1 << 21


# ---------------------------------------------------------------- hashes and levels
def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words and the end token."""
    words = split_words(ascii_lower(F.coalesce(text, F.lit(""))))
    return F.transform(F.concat(words, F.array(F.lit(END))), lambda w: F.xxhash64(w))


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def entry(kind: int, h: np.ndarray) -> np.ndarray:
    """64-bit key of an entry of one kind."""
    with np.errstate(over="ignore"):
        return _splitmix(h.astype(np.int64).view(np.uint64) + np.uint64(kind) * np.uint64(0x9E3779B97F4A7C15))


def follower(w: np.ndarray) -> np.ndarray:
    """40 bits of a word that follows a context."""
    return _splitmix(w.view(np.uint64)) >> np.uint64(24)


def pair_key(v: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit hash of a context and a ``follower``, as int64."""
    with np.errstate(over="ignore"):
        return _splitmix(v.view(np.uint64) + low * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return ((_splitmix(h.view(np.uint64)) >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised log count; 0 below 1."""
    c = np.maximum(count, 1.0)
    return np.where(count >= 1, 1 + np.floor(np.log(c) / log(BASE) + 1e-9), 0).astype(np.int32)


def count_of(q: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the middle of its range on the log scale; level 1 is 1."""
    return np.where(q <= 0, 0.0, np.where(q == 1, 1.0, BASE ** (q - 0.5)))


class Filter:
    """One part of the filter, and its repeated membership probes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits                                   # a byte a bit while in use

    @staticmethod
    def _places(key: np.ndarray, q: int, size: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            g = _splitmix(key + np.uint64(q) * np.uint64(0xC2B2AE3D27D4EB4F))
            low, step = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
            return [((((low + np.uint64(k) * step) & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
                    for k in range(HASHES)]

    @classmethod
    def build(cls, key: np.ndarray, q: np.ndarray) -> "Filter":
        """Insert keys at levels 1 .. q."""
        f = cls(np.zeros(max(64, BITS_PER_ENTRY * int(q.sum())), bool))
        for step in range(1, int(q.max(initial=0)) + 1):
            for at in cls._places(key[q >= step], step, len(f.bits)):
                f.bits[at] = True
        return f

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Highest level before the first missing one, for each key."""
        q = np.zeros(len(key), np.uint8)
        live, k, step = np.arange(len(key)), key, 0
        while len(live):
            step += 1
            hit = np.ones(len(live), bool)
            for at in self._places(k, step, len(self.bits)):
                hit &= self.bits[at]
            live, k = live[hit], k[hit]
            q[live] = step
        return q

    def pack(self) -> bytes:
        return len(self.bits).to_bytes(8, "little") + np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> "Filter":
        n = int.from_bytes(raw[:8], "little")
        return cls(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=n).astype(bool))


# ---------------------------------------------------------------- runs
def _planes(x: np.ndarray) -> bytes:
    """32-bit integers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64)


def _cut_runs(batches, column: int, limit: int):
    """Batches cut into runs of rows of about ``limit`` tokens, which bounds a worker's arrays."""
    for b in batches:
        cut = np.asarray(b.column(column).offsets).astype(np.int64)
        at = 0
        while at < len(b):
            stop = max(at + 1, int(np.searchsorted(cut, cut[at] + limit, side="right")) - 1)
            yield b.slice(at, stop - at)
            at = stop


def token_runs(docs: DataFrame, held_out: Column, p: LMParams, text: str = "text") -> DataFrame:
    """A row a run: run, ids, held (of its documents), cut (first token of each), words, codes, n_tokens, n_train, n_texts."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        for b in _cut_runs(batches, 2, p.run_tokens):
            col = b.column(2)
            cut = np.asarray(col.offsets).astype(np.int64)
            coded = pa.array(np.asarray(col.values)[cut[0]:cut[-1]]).dictionary_encode()
            held = b.column(1).to_numpy(zero_copy_only=False)
            sizes = np.diff(cut)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(0)),
                pa.array([held.tolist()], pa.list_(pa.bool_())),
                pa.array([(cut - cut[0]).astype("<i8").tobytes()], pa.binary()),
                pa.array([coded.dictionary.to_numpy().astype("<i8").tobytes()], pa.binary()),
                pa.array([_planes(coded.indices.to_numpy())], pa.binary()),
                *[pa.array([int(x)]) for x in (sizes.sum(), sizes[~held].sum(), (~held).sum())]],
                ["ids", "held", "cut", "words", "codes", "n_tokens", "n_train", "n_texts"])

    rows = docs.select("doc_id", held_out.alias("held"), token_hashes(F.col(text)).alias("w")).mapInArrow(
        run, f"ids array<{id_type.simpleString()}>, held array<boolean>, cut binary, words binary, codes binary, "
             "n_tokens long, n_train long, n_texts long")
    return materialize(rows.withColumn("run", F.monotonically_increasing_id()), "runs")


class Run:
    """A run's tokens. ``hashes`` are its words and, last, the start mark."""

    def __init__(self, r: dict, begin: int):
        self.cut = np.frombuffer(r["cut"], "<i8")
        self.hashes = np.append(np.frombuffer(r["words"], "<i8"), np.int64(begin))
        self.code = _from_planes(r["codes"], int(self.cut[-1]))
        self.before = np.empty_like(self.code)
        self.before[1:] = self.code[:-1]
        self.before[self.cut[:-1]] = len(self.hashes) - 1
        self.train_text = ~np.asarray(r["held"], bool)
        self.train = np.repeat(self.train_text, np.diff(self.cut))

    def word_counts(self) -> np.ndarray:
        """Training counts of the hashes; the start mark counts once a text."""
        n = np.bincount(self.code[self.train], minlength=len(self.hashes))
        n[-1] = self.train_text.sum()
        return n


class Sending:
    """What a run sends to the groups, in sending order: entries (words at home, and frequent contexts where
    they have bigrams), and different bigrams in the order of their entries."""

    def __init__(self, run: Run, hot: np.ndarray, groups: int):
        n = len(run.hashes)
        pairs, self.token_pair = np.unique(run.before * n + run.code, return_inverse=True)
        v, w = pairs // n, pairs % n
        home = group_of(run.hashes, groups)
        low = follower(run.hashes)[w]
        spread = np.isin(run.hashes, hot)[v]
        where = home[v]
        where[spread] = group_of(pair_key(run.hashes[v[spread]], low[spread]), groups)
        at = where * n + v
        self.order = np.argsort(at, kind="stable")
        keys = np.unique(np.concatenate([home * n + np.arange(n), at]))
        self.entry_group, self.entry = keys // n, keys % n
        self.at_home = home[self.entry] == self.entry_group
        self.n_pairs = np.diff(np.append(np.searchsorted(at[self.order], keys), len(at)))
        self.low, self.v = low[self.order], v[self.order]
        self.pair_group = where[self.order]
        self.pair_train = np.bincount(self.token_pair[run.train], minlength=len(pairs))[self.order]

    def spans(self):
        """(group, entries from, to, bigrams from, to)."""
        groups = np.unique(self.entry_group)
        e = np.searchsorted(self.entry_group, np.append(groups, groups[-1:] + 1))
        p = np.searchsorted(self.pair_group, np.append(groups, groups[-1:] + 1))
        return zip(groups.tolist(), e[:-1].tolist(), e[1:].tolist(), p[:-1].tolist(), p[1:].tolist())


SENT = "group long, run long, hashes binary, n_pairs binary, counts binary, low binary, train binary"


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _send(begin: int, hot, groups: int):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                x = Run(r, begin)
                s, counts = Sending(x, hot.value, groups), x.word_counts()
                counts = np.where(s.at_home, counts[s.entry], 0)
                for g, e0, e1, p0, p1 in s.spans():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([g]), pa.array([r["run"]]),
                        *[pa.array([y], pa.binary()) for y in (
                            run_bytes(x.hashes[s.entry[e0:e1]], "<i8"), run_bytes(s.n_pairs[e0:e1], "<u4"),
                            run_bytes(counts[e0:e1], "<u4"), _five(s.low[p0:p1]), run_bytes(s.pair_train[p0:p1], "<u4"))]],
                        ["group", "run", "hashes", "n_pairs", "counts", "low", "train"])
    return run


def run_bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


# ---------------------------------------------------------------- groups
FOUND = "run long, group long, counts binary, words binary, masses binary, pairs binary, filter binary, types long"


def _count_and_answer(begin: int, hot, groups: int, p: LMParams, whole: bool):
    """Rows sorted by group: a group's rows are counted, inserted and answered together.

    Each run gets its entries' exact training counts and, if the filter is not broadcast, the levels
    that the probes find. A row without a run has the group's part of the filter, its number of
    training words, and what it adds to frequent contexts' masses (as hashes and sums)."""
    def answer(group: int, rows: list[dict]):
        parts = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        hashes = parts("hashes", "<i8")
        each = np.cumsum([len(h) for h in hashes])[:-1]
        known, entry_at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(entry_at, weights=np.concatenate(parts("counts", "<u4")), minlength=len(known)).astype(np.int64)
        low = [_from_five(r["low"]) for r in rows]
        of = np.repeat(entry_at, np.concatenate(parts("n_pairs", "<u4")).astype(np.int64))
        both = (of.astype(np.uint64) << np.uint64(40)) | np.concatenate(low)
        pairs, pair_at = np.unique(both, return_inverse=True)
        c = np.bincount(pair_at, weights=np.concatenate(parts("train", "<u4")), minlength=len(pairs))
        v, stored = (pairs >> np.uint64(40)).astype(np.int64), c >= p.min_bigram
        # Masses in units of the least one, so that none is below 1.
        mass = np.bincount(v[stored], weights=(c[stored] - DISCOUNT) / (1 - DISCOUNT), minlength=len(known))
        home, frequent = group_of(known, groups) == group, np.isin(known, hot.value)
        word_key, mass_key = entry(WORD, known), entry(MASS, known)
        pair_keys = entry(BIGRAM, pair_key(known[v], pairs & np.uint64((1 << 40) - 1)))
        insert = [(word_key[home], counts[home]), (mass_key[~frequent], mass[~frequent]), (pair_keys[stored], c[stored])]
        f = Filter.build(np.concatenate([k for k, _ in insert]), np.concatenate([level(x.astype(float)) for _, x in insert]))
        types = int((home & (counts > 0) & (known != begin)).sum())
        yield (None, group, run_bytes(known[frequent], "<i8"), None, run_bytes(mass[frequent], "<f8"), None,
               f.pack() if whole else None, types)
        if whole:
            levels = [[None] * len(rows)] * 3
        else:
            levels = [np.split(f.levels(k)[at], cut) for k, at, cut in (
                (word_key, entry_at, each), (mass_key, entry_at, each),
                (pair_keys, pair_at, np.cumsum([len(x) for x in low])[:-1]))]
        for r, n, *found in zip(rows, np.split(counts[entry_at], each), *levels):
            yield (r["run"], group, run_bytes(n, "<i8"), *[None if q is None else q.tobytes() for q in found], None, None)

    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64()]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def batch(row):
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def run(batches):
        at, rows = None, []
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                if r["group"] != at and rows:
                    yield from map(batch, answer(at, rows))
                    rows = []
                at = r["group"]
                rows.append(r)
        if rows:
            yield from map(batch, answer(at, rows))
    return run


def frequent_contexts(runs: DataFrame, begin: int, share: float) -> np.ndarray:
    """Hashes of the contexts with at least ``share`` of the training tokens (and of some with half of it), fewer
    than 2 / share. A run leaves out what is below half that share of its tokens, which takes off half at most."""
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                x = Run(r, begin)
                n = x.word_counts()
                some = n > r["n_train"] * share / 2
                yield pa.RecordBatch.from_arrays([pa.array(x.hashes[some]), pa.array(n[some])], ["h", "n"])

    total = runs.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    found = runs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(
        F.col("n") > F.lit(total * share / 2))
    return np.array(sorted(r.h for r in found.select("h").collect()), np.int64)


# ---------------------------------------------------------------- scores
def log_probabilities(words: np.ndarray, masses: np.ndarray, pairs: np.ndarray, v: np.ndarray, w: np.ndarray, n: int,
                      types: int, min_bigram: int) -> np.ndarray:
    """log10 P of bigrams from the filter's levels alone: of different words, of the words' masses as
    contexts, and of each bigram, whose context and word are at ``v`` and ``w`` of the first two."""
    c = count_of(words)
    c_v = np.maximum(c, 1.0)
    mass = np.minimum(count_of(masses) * (1 - DISCOUNT) / c_v, 0.95)
    one = np.minimum((c + 1) / (n + types + 1), 1.0)
    c_vw = np.where(pairs >= level(np.array(float(min_bigram))), count_of(pairs), 0.0)   # lower levels are false hits
    seen = np.minimum(np.maximum(c_vw - DISCOUNT, 0.0) / c_v[v], mass[v])
    return np.log10(seen + (1 - mass[v]) * one[w])


def _total(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums over each text's tokens (every text has one at least)."""
    return np.add.reduceat(x, cut[:-1]) if len(cut) > 1 else np.zeros(0)


def score_texts(docs: DataFrame, buckets: int = 7, held_bucket: int = 2, params: LMParams = LMParams(),
                text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    spark, p = docs.sparkSession, params
    held = F.coalesce(id_bucket(F.col("doc_id"), buckets) == held_bucket, F.lit(False))
    begin = int(spark.range(1).select(F.xxhash64(F.lit(BEGIN))).first()[0])
    runs = token_runs(docs, held, p, text)
    tokens, n = runs.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_train")]).first()
    groups = max(1, -(-tokens // p.group_tokens))
    hot = spark.sparkContext.broadcast(frequent_contexts(runs, begin, max(1 / (2 * groups), LEAST_SHARE)))
    whole = n * BITS_PER_TOKEN <= p.max_filter_bits
    sent = runs.mapInArrow(_send(begin, hot, groups), SENT).repartition("group").sortWithinPartitions("group")
    found = materialize(sent.mapInArrow(_count_and_answer(begin, hot, groups, p, whole), FOUND), "found")

    parts = found.where("run IS NULL")
    types = parts.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    # Frequent contexts: a sum and a hash from each group that has some, added up on the way.
    masses: dict[int, float] = dict.fromkeys(hot.value.tolist(), 0.0)
    for r in parts.where(F.octet_length("counts") > 0).select("counts", "masses").toLocalIterator():
        for h, m in zip(np.frombuffer(r["counts"], "<i8").tolist(), np.frombuffer(r["masses"], "<f8").tolist()):
            masses[h] += m
    hot_part = Filter.build(entry(MASS, hot.value), level(np.array([masses[h] for h in hot.value.tolist()])))
    filters = {-1: hot_part.pack()}
    if whole:                                              # at most max_filter_bits
        filters |= {r["group"]: bytes(r["filter"]) for r in parts.select("group", "filter").toLocalIterator()}
    shared = spark.sparkContext.broadcast(filters)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        x = Run(r, begin)
        s = Sending(x, hot.value, groups)
        size = len(x.hashes)
        exact, words, mass = np.zeros(size, np.int64), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        pairs = np.zeros(len(s.low), np.uint8)
        answers = {a["group"]: a for a in right.to_pylist()}
        for g, e0, e1, p0, p1 in s.spans():
            a, home = answers[g], s.at_home[e0:e1]
            at = s.entry[e0:e1][home]
            exact[at] = np.frombuffer(a["counts"], "<i8")[home]
            if whole:
                f = Filter.unpack(shared.value[g])
                words[at] = f.levels(entry(WORD, x.hashes[at]))
                mass[at] = f.levels(entry(MASS, x.hashes[at]))
                pairs[p0:p1] = f.levels(entry(BIGRAM, pair_key(x.hashes[s.v[p0:p1]], s.low[p0:p1])))
            else:
                words[at], mass[at] = (np.frombuffer(a[c], np.uint8)[home] for c in ("words", "masses"))
                pairs[p0:p1] = np.frombuffer(a["pairs"], np.uint8)
        often = np.isin(x.hashes, hot.value)
        mass[often] = Filter.unpack(shared.value[-1]).levels(entry(MASS, x.hashes[often]))
        token_level = np.empty(len(pairs), np.uint8)
        token_level[s.order] = pairs                        # back to the order of the different bigrams
        lp = log_probabilities(words.astype(np.int32), mass.astype(np.int32), token_level[s.token_pair].astype(np.int32),
                               x.before, x.code, n, types, p.min_bigram)
        base = np.log10((exact + 1) / (n + types + 1))
        return pa.table({
            "doc_id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(~x.train_text),
            "n_tokens": pa.array(np.diff(x.cut)), "n_known": pa.array(_total((exact > 0)[x.code].astype(np.int64), x.cut)),
            "base_score": pa.array(_total(base[x.code], x.cut)), "score": pa.array(_total(lp, x.cut))})

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, base_score double, score double")])
    told = found.where("run IS NOT NULL").select("run", "group", "counts", "words", "masses", "pairs")
    scored = runs.select("run", "ids", "held", "cut", "words", "codes").groupBy("run").cogroup(
        told.groupBy("run")).applyInArrow(score, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                         "base_score", "score")
