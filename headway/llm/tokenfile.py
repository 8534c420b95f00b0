"""Token ids on disk as Simple-8b blocks.

Documents are encoded in ascending id order (one range shuffle of the texts), the ids of a
range become one stream, and the stream is cut into blocks of BLOCK ids. A block is coded
in 64-bit words: the top four bits select how many ids of how many bits share the other
sixty. Selector 0 is an escape: the next whole word is one raw 64-bit id. No word crosses a
block, and the file keeps the offset of each block's first word, so blocks are encoded and
decoded side by side with array operations.

The file is a Parquet table written by Spark, a row a chunk (about CHUNK ids of whole
documents): part, chunk, first (ids before it in its part), doc_ids, lengths, n_ids, block_words
(first word of each block and the number of words), words. Documents of a range follow one another by (part, chunk), and a
chunk never needs more than its own documents in memory.

Defined cases: a null or empty text is its end id alone; null ids sort first; repeated ids
follow one another in the order of their texts' hashes, repeated rows adjacent; other
columns are left out; an empty table gives an empty file and no rows. Ids are 64-bit integers; a
text id that is not one raises.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from headway.llm.bpe import ragged

#: (ids in a word, bits of each) of selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
             (3, 20), (2, 30), (1, 60))
ESCAPE = 0
BLOCK = 1024
CHUNK = 1 << 20
BATCH_BYTES = 1 << 23
CACHE = 1_000_000
FILE = ("part int, chunk int, first long, doc_ids array<long>, lengths array<long>, n_ids long, "
        "block_words binary, words binary")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the number of words) of 64-bit ids."""
    n = len(ids)
    rows = -(-n // BLOCK)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = ids
    padded = np.zeros((rows, BLOCK + 60), np.uint64)       # zeros beyond a block's end fit any word
    padded[:, :BLOCK] = flat.reshape(rows, BLOCK)
    length = np.full(rows, BLOCK, np.int64)
    if rows:
        length[-1] = n - (rows - 1) * BLOCK
    # The narrowest selector that holds each id (15: none), and its maximum over the next ids:
    # a selector fits where the maximum over its count of ids is not above its own number.
    narrow = np.full(padded.shape, len(SELECTORS) + 1, np.uint8)
    for number in range(len(SELECTORS), 0, -1):
        np.copyto(narrow, number, where=padded < np.uint64(1 << SELECTORS[number - 1][1]))
    best = np.zeros((rows, BLOCK), np.uint8)
    widest, have = narrow, 1
    for number in range(len(SELECTORS), 0, -1):
        count = SELECTORS[number - 1][0]
        while have < count:                                # maximum over more ids
            more = min(have, count - have)
            grown = widest.copy()
            np.maximum(widest[:, :-more], widest[:, more:], out=grown[:, :-more])
            widest, have = grown, have + more
        np.copyto(best, number, where=widest[:, :BLOCK] <= number)
    jump = np.array([1, *(c for c, _ in SELECTORS)])
    at = np.zeros(rows, np.int64)
    live = np.flatnonzero(at < length)
    found = []
    while len(live):                                       # a word of every unfinished block
        number = best[live, at[live]]
        found.append((live, at[live], number))
        at[live] += jump[number]
        live = live[at[live] < length[live]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    block, start, number = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, block))
    block, start, number = block[order], start[order], number[order].astype(np.int64)
    size = np.where(number == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in np.unique(number):
        here = number == k
        if k == ESCAPE:
            words[place[here] + 1] = padded[block[here], start[here]]
            continue
        count, bits = SELECTORS[k - 1]
        got = padded[block[here][:, None], start[here][:, None] + np.arange(count)]
        # Ids beyond the block's end lie in the padding and are zero.
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        words[place[here]] = np.bitwise_or.reduce(got << shifts, axis=1) | (np.uint64(k) << np.uint64(60))
    per_block = np.bincount(block, weights=size, minlength=rows).astype(np.int64)
    return words, np.append(0, np.cumsum(per_block))


def unpack(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The ids of ``pack``. Blocks with an escape are read word by word, the others together."""
    rows = len(block_words) - 1
    out = np.zeros((rows, BLOCK + 60), np.uint64)
    select = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(rows), np.diff(block_words))
    escaped = np.zeros(rows, bool)
    escaped[block[select == ESCAPE]] = True
    jump = np.array([1, *(c for c, _ in SELECTORS), 0])
    counts = np.where(escaped[block], 0, jump[select])
    before = np.cumsum(counts) - counts
    inside = before - before[np.minimum(block_words[:-1], len(words) - 1)][block] if len(words) else before
    for k in np.unique(select[~escaped[block]]):
        count, bits = SELECTORS[k - 1]
        here = np.flatnonzero((select == k) & ~escaped[block])
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        mask = np.uint64((1 << bits) - 1)
        out[block[here][:, None], inside[here][:, None] + np.arange(count)] = (words[here][:, None] >> shifts) & mask
    for r in np.flatnonzero(escaped):
        w, at = int(block_words[r]), 0
        while w < block_words[r + 1]:
            k = int(select[w])
            if k == ESCAPE:
                out[r, at] = words[w + 1]
                w, at = w + 2, at + 1
                continue
            count, bits = SELECTORS[k - 1]
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[r, at:at + count] = (words[w] >> shifts) & np.uint64((1 << bits) - 1)
            w, at = w + 1, at + count
    return out[:, :BLOCK].ravel()[:n]


@lru_cache(4)
def _tokenizer(path: str) -> tuple[Tokenizer, dict[str, bytes]]:
    return Tokenizer.from_file(path), {}


def _encode_words(tok: Tokenizer, words: list[str]) -> list[bytes]:
    """Ids of each word (no white space inside), as 32-bit integers, from one call on all of them."""
    e = tok.encode(" ".join(words), add_special_tokens=False)
    ids = np.array(e.ids, "<u4")
    first = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(size) - size
    cut = 4 * np.searchsorted(first, np.append(starts, size.sum()))
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _fewer_words(texts: pa.Array) -> pa.Array:
    """Texts with the same ids but fewer different words.

    The tokenizer lower-cases, and always splits a letter from a full stop or comma. Texts
    that may name a special token are left alone: those are matched before lower-casing. So are
    texts with a combining mark: the tokenizer composes first, and some capitals have no
    composed form although their small letters do (J with U+030C).
    """
    texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy: ascii_lower misreads a slice's offsets
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])", r"\1 \2")
    return pc.if_else(pc.match_substring_regex(texts, r"<\||[\x{0300}-\x{036F}]"), texts, plain)


def encode_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each).

    The tokenizer drops white space and never joins across it, so a text's ids are those
    of its words between ASCII white space; equal words of a batch are encoded once, and
    the first CACHE different words of a worker are remembered.
    """
    tok, cache = _tokenizer(path)
    split = pc.ascii_split_whitespace(_fewer_words(texts.cast(pa.large_string())))
    coded = split.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    each = [cache.get(w) for w in words]
    new = [i for i, ids in enumerate(each) if ids is None]
    for lo in range(0, len(new), 20_000):
        some = new[lo:lo + 20_000]
        for i, ids in zip(some, _encode_words(tok, [words[i] for i in some])):
            each[i] = ids
            if len(cache) < CACHE:
                cache[words[i]] = ids
    n_each = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), "<u4")
    which = coded.indices.to_numpy()
    counts = n_each[which]
    total = np.append(0, np.cumsum(counts))
    ids = flat[ragged((np.cumsum(n_each) - n_each)[which], counts)]
    return ids.astype(np.uint64), np.diff(total[np.asarray(split.offsets)])


def _runs(texts: pa.Array):
    """(from, to) of rows, each run of about BATCH_BYTES of text."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    at, total = 0, 0
    for i, s in enumerate(size):
        total += int(s)
        if total >= BATCH_BYTES:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(size):
        yield at, len(size)


def _row(part: int, chunk: int, first: int, doc_ids: list, lengths: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
    stream = np.concatenate(ids)
    words, block_words = pack(stream)
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()),
        pa.array([doc_ids], pa.list_(pa.int64())),
        pa.array([lengths], pa.list_(pa.int64())), pa.array([len(stream)], pa.int64()),
        pa.array([block_words.astype("<i8").tobytes()], pa.binary()),
        pa.array([words.astype("<u8").tobytes()], pa.binary())],
        ["part", "chunk", "first", "doc_ids", "lengths", "n_ids", "block_words", "words"])


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 1, id_col: str = "doc_id",
                 text: str = "text") -> None:
    """Encode ``docs`` with the tokenizer file ``path`` and write the token file ``out``."""
    def run(batches):
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, size = [], [], [], 0
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            keys = b.column(0).to_pylist()
            for lo, hi in _runs(texts):
                ids, counts = encode_batch(texts.slice(lo, hi - lo), path)
                at = np.cumsum(counts)
                ids = np.insert(ids, at, np.uint64(end_id))
                counts = counts + 1
                cut = np.append(0, np.cumsum(counts))
                i = lo
                while i < hi:                              # fill the open chunk, whole documents at a time
                    j = int(np.searchsorted(cut, cut[i - lo] + CHUNK - size)) + lo
                    j = min(max(j, i + 1), hi)
                    doc_ids += keys[i:j]
                    lengths += counts[i - lo:j - lo].tolist()
                    held.append(ids[cut[i - lo]:cut[j - lo]])
                    size += len(held[-1])
                    i = j
                    if size >= CHUNK:
                        yield _row(part, chunk, first, doc_ids, lengths, held)
                        chunk, first = chunk + 1, first + size
                        doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield _row(part, chunk, first, doc_ids, lengths, held)

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"),
                    F.xxhash64(F.col(text)).alias("_tie"))
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    d.mapInArrow(run, FILE).write.parquet(out)


def read_tokens(spark: SparkSession, file: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a token file; ids as little-endian unsigned 32-bit integers.

    A chunk's first position is its place in its part, which the file holds, and the sum over
    earlier parts: a row a part, as many as there were write tasks, is broadcast.
    """
    f = spark.read.schema(FILE).parquet(file)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = f.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["block_words"], "<i8"),
                             r["n_ids"]).astype("<u4")
                cut = np.append(0, np.cumsum(r["lengths"]))
                for lo in range(0, len(r["lengths"]), 1000):
                    hi = min(lo + 1000, len(r["lengths"]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(r["doc_ids"][lo:hi], pa.int64()), pa.array(r["first"] + cut[lo:hi], pa.int64()),
                        pa.array(r["lengths"][lo:hi], pa.int64()),
                        pa.array([ids[cut[i]:cut[i + 1]].tobytes() for i in range(lo, hi)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    return f.join(F.broadcast(parts), "part").withColumn("first", F.col("first") + F.col("_before")).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
