"""Line dedup: repeated lines leave all documents but the one with the smallest id.

A line's key is the line without outer white space, A-Z lower-cased; keys of at least
``min_chars`` code points count. Keys are known by their 128-bit xxh3 hash. Instead of a
join of lines there is an index, in shards of the hashes: a minimal perfect hash
(``PerfectHash``) maps a shard's n different hashes to 0 .. n-1, and arrays in that order
hold a fingerprint, the number of rows with the line (255 means that or more) and,
for lines of several documents, the smallest document. Probes, one per document and hash,
go to the shard's task, which reads the shard's arrays and answers batch by batch; only the
lines to drop come back.

Hot lines: hashes held by more than ``lines / MAX_HOT`` rows (fewer than ``MAX_HOT`` of them,
whatever the input) form one further shard, small enough to be broadcast with every task,
which answers them on the spot. So no line sends its documents to one task, and no shard
gets more than its lines times that share. Before the index is shuffled each task adds up
the equal hashes of a batch of documents.

Defined cases: a null or empty text is one empty line; rows with one doc_id are one document
(repeated rows keep or lose the same lines); a null doc_id is one document that comes after
all others; texts are never cut; other columns are ignored; an empty table gives an empty
output. Two different keys are taken for one only when 128 bits agree.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from headway.session import materialize

#: Fewer hashes than this are hot.
MAX_HOT = 1 << 14
#: Lines of a shard, on average.
SHARD_LINES = 1 << 15
MIN_CHARS = 10
NO_ID = np.iinfo(np.int64).max                             # a null doc_id: after all others
SPACE = b" \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- perfect hash
def _mixed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """A well-mixed 64-bit value of both halves, another one for each level."""
    with np.errstate(over="ignore"):
        x = hi ^ (lo + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of different 128-bit keys (hi, lo).

    Each level has twice as many bits as keys are left: a key alone on its bit sets it,
    the others go on to the next level. A key's number is the count of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels                               # one byte array of packed bits a level
        starts, ranks, before = [], [], 0
        for bits in levels:
            ones = np.unpackbits(bits).astype(np.int64)
            ranks.append(before + np.cumsum(ones) - ones)
            starts.append(ones.astype(bool))
            before += int(ones.sum())
        self.set, self.rank, self.n = starts, ranks, before

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> "PerfectHash":
        levels = []
        while len(hi):
            if len(levels) == 64:
                raise ValueError("keys are not different")
            size = (2 * len(hi) + 7) // 8 * 8
            at = (_mixed(hi, lo, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(levels)

    def numbers(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Each key's number; -1 where no level holds the key."""
        out = np.full(len(hi), -1, np.int64)
        todo = np.arange(len(hi))
        for k, (held, rank) in enumerate(zip(self.set, self.rank)):
            if not len(todo):
                break
            at = (_mixed(hi[todo], lo[todo], k) % np.uint64(len(held))).astype(np.int64)
            found = held[at]
            out[todo[found]] = rank[at[found]]
            todo = todo[~found]
        return out


class Shard:
    """The arrays of one shard, probed together."""

    def __init__(self, index: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        self.index, self.fingerprints, self.counts, self.holders = index, fingerprints, counts, holders
        shared = counts > 1
        self.holder_at = np.cumsum(shared) - shared

    @classmethod
    def build(cls, hi, lo, rows, least, shared, width=np.uint32) -> "Shard":
        """From different hashes with their rows, smallest document and whether several documents hold them.

        32-bit fingerprints suffice where every probe is a key; a shard that is asked for other
        keys as well takes the whole 64 bits of ``lo``."""
        index = PerfectHash.build(hi, lo)
        at = index.numbers(hi, lo)
        counts, prints = np.zeros(len(hi), np.uint8), np.zeros(len(hi), width)
        holders = np.zeros(len(hi), np.int64)
        counts[at] = np.where(shared, np.clip(rows, 2, 255), 1)
        prints[at] = lo.astype(width)                      # its low bits
        holders[at] = least
        return cls(index, prints, counts, holders[counts > 1])

    def dropped(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(held here, to be dropped from this document)."""
        at = self.index.numbers(hi, lo)
        held = at >= 0
        if held.any():
            held[held] = self.fingerprints[at[held]] == lo[held].astype(self.fingerprints.dtype)
        drop = held.copy()
        drop[held] = self.counts[at[held]] > 1
        drop[drop] = self.holders[self.holder_at[at[drop]]] != doc[drop]
        return held, drop

    def pack(self) -> bytes:
        parts = [*self.index.levels, self.fingerprints, self.counts, self.holders]
        sizes = [len(x) for x in parts]
        width = self.fingerprints.dtype.itemsize
        return struct.pack(f"<II{len(sizes)}Q", width, len(sizes), *sizes) + b"".join(x.tobytes() for x in parts)

    @classmethod
    def unpack(cls, packed: bytes) -> "Shard":
        width, n = struct.unpack_from("<II", packed)
        sizes, at, parts = struct.unpack_from(f"<{n}Q", packed, 8), 8 + 8 * n, []
        for size, kind in zip(sizes, [np.uint8] * (n - 3) + [f"<u{width}", np.uint8, np.int64]):
            parts.append(np.frombuffer(packed, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(PerfectHash(parts[:-3]), *parts[-3:])


# ---------------------------------------------------------------- lines
def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte hash of a line's key, None when the key is short."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())             # bytes.lower() changes A-Z only


def _doc_lines(min_chars: int):
    """Documents to (doc, n, hashes): the different hashes of a document's lines, 16 bytes each."""
    def run(batches):
        for b in batches:
            docs, packed = b.column("doc_id").to_pylist(), []
            for text in b.column("text"):
                lines = (text.as_py() or "").encode().split(b"\n")
                packed.append(b"".join({h for x in lines if (h := line_hash(x, min_chars))}))
            yield pa.RecordBatch.from_arrays(
                [pa.array([NO_ID if d is None else d for d in docs], pa.int64()),
                 pa.array([len(x) // 16 for x in packed], pa.int64()), pa.array(packed, pa.binary())],
                names=["doc", "n", "hashes"])
    return run


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, doc) of every hash in a batch of documents."""
    n = b.column("n").to_numpy(zero_copy_only=False)
    both = np.frombuffer(b"".join(b.column("hashes").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1], np.repeat(b.column("doc").to_numpy(zero_copy_only=False), n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return (hi % np.uint64(shards)).astype(np.int64)


def _counted(shards: int):
    """Documents to index entries, equal hashes of a batch added up."""
    def run(batches):
        for b in batches:
            hi, lo, doc = _flat(b)
            if not len(hi):
                continue
            order = np.lexsort((doc, lo, hi))
            hi, lo, doc = hi[order], lo[order], doc[order]
            first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            last = np.r_[first[1:], len(hi)] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(_shard_of(hi[first], shards)), _signed(hi[first]), _signed(lo[first]), pa.array(last - first + 1),
                 pa.array(doc[first]), pa.array(doc[last])], names=["shard", "hi", "lo", "rows", "least", "most"])
    return run


def _built(hot_rows: int):
    """Entries sorted by (shard, hi, lo) to a row a shard: its arrays, and its hot entries apart."""
    def shard_row(shard: int, pieces: list[np.ndarray]):
        e = np.concatenate(pieces)                          # columns: hi, lo, rows, least, most
        first = np.flatnonzero(np.r_[True, (e[1:, 0] != e[:-1, 0]) | (e[1:, 1] != e[:-1, 1])])
        hi, lo = e[first, 0].view(np.uint64), e[first, 1].view(np.uint64)
        rows = np.add.reduceat(e[:, 2], first)
        least, most = np.minimum.reduceat(e[:, 3], first), np.maximum.reduceat(e[:, 4], first)
        hot = rows > hot_rows
        cold = Shard.build(hi[~hot], lo[~hot], rows[~hot], least[~hot], (least != most)[~hot])
        apart = np.stack([hi.view(np.int64), lo.view(np.int64), rows, least, (least != most).astype(np.int64)], 1)[hot]
        return shard, cold.pack(), apart.tobytes()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.binary()),
                                           pa.array([r[2] for r in rows], pa.binary())], names=["shard", "packed", "hot"])

    def run(batches):
        at, pieces = None, []
        for b in batches:
            shard = b.column("shard").to_numpy(zero_copy_only=False)
            e = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "rows", "least", "most")], 1)
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for piece, s in zip(np.split(e, cuts), shard[np.r_[0, cuts]] if len(shard) else []):
                if s != at and pieces:
                    yield batch_of([shard_row(at, pieces)])
                    pieces = []
                at = int(s)
                pieces.append(piece)
        if pieces:
            yield batch_of([shard_row(at, pieces)])
    return run


def _probes(shards: int, hot: bytes, answers: bool):
    """Documents to probes (shard, hi, lo, doc) of lines that are not hot, or to the hot lines to be dropped."""
    def run(batches):
        shared = Shard.unpack(hot)
        for b in batches:
            hi, lo, doc = _flat(b)
            held, drop = shared.dropped(hi, lo, doc)
            keep = drop if answers else ~held
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(hi, shards)[keep]), _signed(hi[keep]), _signed(lo[keep]),
                                              pa.array(doc[keep])], names=["shard", "hi", "lo", "doc"])
    return run


def _answers(batches):
    """Rows sorted by (shard, probes after arrays): the probes whose line leaves its document."""
    at, shard = None, None
    for b in batches:
        numbers, packed = b.column("shard").to_numpy(zero_copy_only=False), b.column("packed")
        probe = np.asarray(packed.is_null())
        hi, lo, doc = (b.column(c) for c in ("hi", "lo", "doc"))
        cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (probe[1:] != probe[:-1])) + 1
        for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(numbers)].tolist()):
            if i == j:
                continue
            if not probe[i]:
                at, shard = int(numbers[j - 1]), Shard.unpack(packed[j - 1].as_py())
                continue
            if numbers[i] != at:
                raise ValueError(f"shard {numbers[i]} has probes but no arrays")
            h, lw, d = (x.slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hi, lo, doc))
            held, drop = shard.dropped(h.view(np.uint64), lw.view(np.uint64), d)
            if not held.all():
                raise ValueError("a document's line is not in the index")
            yield pa.RecordBatch.from_arrays([pa.array(d[drop]), pa.array(h[drop]), pa.array(lw[drop])], names=["doc", "hi", "lo"])


def line_index(lines: DataFrame, shards: int, hot_rows: int) -> DataFrame:
    """(shard, packed, hot) of a table written from ``_doc_lines``."""
    entries = lines.mapInArrow(_counted(shards), "shard long, hi long, lo long, rows long, least long, most long")
    entries = entries.repartition("shard").sortWithinPartitions("shard", "hi", "lo")
    return materialize(entries.mapInArrow(_built(hot_rows), "shard long, packed binary, hot binary"), "lineindex")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_hot: int = MAX_HOT,
                   shard_lines: int = SHARD_LINES) -> DataFrame:
    """(doc, hi, lo): the hashes of the lines that leave a document, one row each. ``doc`` is the id."""
    lines = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                        .mapInArrow(_doc_lines(min_chars), "doc long, n long, hashes binary"), "lines")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards, hot_rows = total // shard_lines + 1, total // max_hot + 1
    index = line_index(lines, shards, hot_rows)
    # Fewer than max_hot entries of 40 bytes.
    hot = b"".join(bytes(r.hot) for r in index.where(F.octet_length("hot") > 0).select("hot").toLocalIterator())
    e = np.frombuffer(hot, np.int64).reshape(-1, 5)
    shared = Shard.build(e[:, 0].copy().view(np.uint64), e[:, 1].copy().view(np.uint64), e[:, 2], e[:, 3], e[:, 4] > 0,
                          np.uint64)
    probes, answered = (lines.mapInArrow(_probes(shards, shared.pack(), a), "shard long, hi long, lo long, doc long")
                        for a in (False, True))
    none = F.lit(None)
    both = probes.withColumn("packed", none.cast("binary")).unionByName(
        index.select("shard", "packed", *[none.cast("long").alias(c) for c in ("hi", "lo", "doc")]))
    both = both.repartition("shard").sortWithinPartitions("shard", F.col("packed").isNull())
    cold = both.mapInArrow(_answers, "doc long, hi long, lo long")
    return cold.unionByName(answered.select("doc", "hi", "lo"))


def _kept(min_chars: int):
    """Adds the kept text, the number of lines and of dropped lines to documents with their dropped hashes."""
    def run(batches):
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(b.column("text"), b.column("gone")):
                lines = (text.as_py() or "").encode().split(b"\n")
                out = set(gone.as_py() or ())
                stay = [x for x in lines if line_hash(x, min_chars) not in out] if out else lines
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            names = b.schema.names
            cols = [b.column(c) for c in names if c not in ("text", "gone")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[c for c in names if c not in ("text", "gone")] + ["kept", "n_lines", "n_dropped"])
    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_hot: int = MAX_HOT,
                shard_lines: int = SHARD_LINES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, kept (UTF-8 of the lines that stay), n_lines, n_dropped."""
    gone = repeated_lines(docs, min_chars, max_hot, shard_lines)
    both = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo")]))
    gone = gone.groupBy("doc").agg(F.collect_list(both).alias("gone"))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc"))
    rows = rows.join(gone, "doc", "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(_kept(min_chars), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, "
                                             "n_lines long, n_dropped long")


def line_digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))

