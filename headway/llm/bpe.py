"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch become one array of code points, a table maps each to a class (letter,
number, white space, other), and a look at the next one or two code points turns classes
into the input symbols of a small automaton. The automaton's transition functions under
composition form a small monoid: its elements are numbered and their products tabled, so
the state before every code point follows from an associative prefix scan over element
numbers, in blocks, without a regular expression. A symbol and the state before it say
whether a piece starts there. Pieces are slices of the UTF-8 buffer; equal slices of a
batch are merged once, through a cache, by lowest rank first.

The pieces are those of the pattern of the published 50k byte-level vocabularies:
contractions 's 't 're 've 'm 'll 'd, runs of letters, numbers or others with at most one
space before them, and white space (its last character, if text follows, apart).

Decoding is a gather from the vocabulary's bytes; the byte end of every token is kept, so
any range of tokens can be decoded alone.

Defined cases: a null or empty text has no tokens and decodes to no bytes; repeated rows
are encoded alike; text of any length is encoded whole (beyond SEGMENT bytes it is cut
before a single space between ASCII words, where a piece always starts); other columns
than the id and the text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the property White_Space (fixed values).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: other, letter, number, white space before white space or the end, a space before
# text, other white space before text, an apostrophe that may open a contraction of one or of
# two letters. RESET is added at the first code point of a text.
S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_JOIN, S_LAST, S_ONE, S_TWO = range(8)
RESET = 8
# States: a piece has just ended; inside letters, numbers, others, white space; after a space
# that joins the next piece; one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, WHITES, JOINED, ONE_LEFT, TWO_LEFT = range(8)

SEGMENT = 1 << 20
BLOCK = 128
CACHE = 200_000
_FIELDS = (StructField("n_tokens", LongType()), StructField("ids", BinaryType()))


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here", by symbol and state."""
    begin = {S_OTHER: OTHERS, S_LETTER: LETTERS, S_NUMBER: NUMBERS, S_WHITE: WHITES, S_JOIN: JOINED,
             S_LAST: FRESH, S_ONE: ONE_LEFT, S_TWO: TWO_LEFT}
    goes_on = {(LETTERS, S_LETTER): LETTERS, (NUMBERS, S_NUMBER): NUMBERS, (WHITES, S_WHITE): WHITES,
               (JOINED, S_LETTER): LETTERS, (JOINED, S_NUMBER): NUMBERS}
    for s in (S_OTHER, S_ONE, S_TWO):
        goes_on[OTHERS, s] = goes_on[JOINED, s] = OTHERS
    for s in range(8):
        goes_on[ONE_LEFT, s], goes_on[TWO_LEFT, s] = FRESH, ONE_LEFT
    step, start = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for s in range(8):
        step[s] = step[s + RESET] = begin[s]
        for q in range(8):
            if (q, s) in goes_on:
                step[s, q], start[s, q] = goes_on[q, s], False
    return step, start


@lru_cache(1)
def _monoid():
    """Transition functions closed under composition: (product table, functions, number of each symbol's)."""
    step, start = _automaton()
    seen, todo = {}, []

    def number(f):
        if f not in seen:
            seen[f] = len(seen)
            todo.append(f)
        return seen[f]

    number(tuple(range(8)))                               # the identity has number 0
    symbols = [number(tuple(map(int, f))) for f in step]
    gens = [tuple(map(int, f)) for f in step]
    while todo:
        f = todo.pop()
        for g in gens:
            number(tuple(g[f[q]] for q in range(8)))
    funs = sorted(seen, key=seen.get)
    product = np.array([[seen[tuple(g[f[q]] for q in range(8))] for g in funs] for f in funs], np.int32)
    return product, np.array(funs, np.uint8), np.array(symbols, np.int32), start


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    t[WHITE] = SPACE
    return t


def _symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Automaton symbols; ``first`` has the positions at which texts start."""
    n = len(cp)
    cls = _classes()[cp]
    ends = np.zeros(n + 2, bool)                           # a text starts here, or all has ended
    ends[first] = True
    ends[n:] = True
    after = np.append(cls, [SPACE, SPACE])[1:n + 1]
    last = (after != SPACE) & ~ends[1:n + 1]               # text follows within the same text
    sym = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE], np.int32)[cls]
    white = cls == SPACE
    sym[white & last] = S_LAST
    sym[white & last & (cp == 0x20)] = S_JOIN
    apostrophes = np.flatnonzero(cp == 0x27)
    if len(apostrophes):
        wide = np.append(cp, [0, 0])
        a, b = wide[apostrophes + 1], wide[apostrophes + 2]
        one = ~ends[apostrophes + 1]
        two = one & ~ends[apostrophes + 2]
        is_in = lambda x, s: np.isin(x, [ord(c) for c in s])
        sym[apostrophes[one & is_in(a, "stmd")]] = S_ONE
        e_or_l = (is_in(a, "rv") & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[apostrophes[two & e_or_l]] = S_TWO
    sym[first] += RESET
    return sym


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces start, by an associative scan of transition functions."""
    product, funs, numbers, start = _monoid()
    n, k = len(cp), len(funs)
    if not n:
        return np.zeros(0, np.int64)
    sym = _symbols(cp, first)
    rows = -(-n // BLOCK)
    fun = np.zeros(rows * BLOCK, np.int32)
    fun[:n] = numbers[sym]
    fun = np.ascontiguousarray(fun.reshape(rows, BLOCK).T)
    table = product.ravel()
    acc, before = np.zeros(rows, np.int32), np.empty((BLOCK, rows), np.int32)
    for t in range(BLOCK):                                 # all blocks in step
        before[t] = acc
        acc = table[acc * k + fun[t]]
    gap = 1
    while gap < rows:                                      # inclusive scan over block products
        acc[gap:] = table[acc[:-gap] * k + acc[gap:]]
        gap *= 2
    enter = np.zeros(rows, np.intp)
    enter[1:] = funs[acc[:-1], FRESH]
    state = funs[before, enter[None, :]].T.ravel()[:n]
    return np.flatnonzero(start[sym, state])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank (leftmost among equals) is merged until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))   # token that starts at i: its end; start of the one before
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)

    def offer(i):
        j = end[i]
        if j < n:
            r = ranks.get(piece[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:              # one of the two has been merged since
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            prev[stop] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0] + lengths[0] - 1, starts[1] .. and so on."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes batches of UTF-8 texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}                 # piece -> ids as 32-bit integers
        size = max(ranks.values(), default=-1) + 1
        words = [b""] * size
        for w, i in ranks.items():
            words[i] = w
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def _ids(self, piece: bytes) -> bytes:
        ids = self.cache.get(piece)
        if ids is None:
            ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
            if len(piece) <= 64 and len(self.cache) < CACHE:
                self.cache[piece] = ids
        return ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as one array, number of ids of each text)."""
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        at = np.cumsum(width) - width                      # byte at which a code point starts
        text_at = np.cumsum(sizes) - sizes
        first = np.searchsorted(at, text_at[sizes > 0])
        starts = at[piece_starts(cp, first)]
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        each = [self._ids(p) for p in coded.dictionary.to_pylist()]
        n_each = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        which = coded.indices.to_numpy()
        counts = n_each[which]
        ids = flat[ragged((np.cumsum(n_each) - n_each)[which], counts)]
        total = np.append(0, np.cumsum(counts))            # ids before each piece
        text_piece = np.searchsorted(starts, np.append(text_at, len(data)))
        return ids, np.diff(total[text_piece])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token ends."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


_CUT = re.compile(rb"[\x21-\x7e] (?=[\x21-\x7e])")


def segments(text: bytes, limit: int = SEGMENT) -> list[bytes]:
    """Parts of about ``limit`` bytes whose pieces are those of the whole text."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _CUT.search(text, at + limit)
        if not m:
            break
        out.append(text[at:m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


def _encode_rows(enc: Encoder, texts: list[bytes]):
    """Ids of each text, worked on in runs of about SEGMENT bytes."""
    run, owner, size, done = [], [], 0, {}

    def flush():
        ids, counts = enc.encode(run)
        for i, part in zip(owner, np.split(ids, np.cumsum(counts)[:-1])):
            done.setdefault(i, []).append(part)

    for i, t in enumerate(texts):
        for s in segments(t):
            run.append(s)
            owner.append(i)
            size += len(s)
            if size >= SEGMENT:
                flush()
                run, owner, size = [], [], 0
    if run:
        flush()
    return [np.concatenate(done[i]) for i in range(len(texts))]


def _slices(batches, column: int):
    """Batches cut into rows of about SEGMENT bytes in all, which bounds a worker's arrays."""
    for b in batches:
        size = np.cumsum([len(x or b"") for x in b.column(column).cast(pa.binary()).to_pylist()])
        at = 0
        while at < len(b):
            done = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, done + SEGMENT, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _encoding(path: str, id_col: str):
    def run(batches):
        enc = encoder(path)
        for b in _slices(batches, 1):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            ids = _encode_rows(enc, texts)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([enc.ends(x).astype("<i8").tobytes() for x in ids], pa.binary())],
                [id_col, "n_tokens", "ids", "ends"])
    return run


def _decoding(path: str, id_col: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            decoded = [enc.decode(np.frombuffer(x, "<u4")) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(decoded, pa.binary())],
                                             [id_col, "n_tokens", "ids", "decoded"])
    return run


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids, ends): ids as little-endian unsigned 32-bit integers; ends as 64-bit byte offsets."""
    schema = StructType([docs.schema[id_col], *_FIELDS, StructField("ends", BinaryType())])
    return docs.select(id_col, text).mapInArrow(_encoding(path, id_col), schema)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, decoded) of rows with ``ids`` as made by ``encode_texts``."""
    schema = StructType([encoded.schema[id_col], *_FIELDS, StructField("decoded", BinaryType())])
    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(_decoding(path, id_col), schema)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode_ids`` of ``encode_texts`` in one worker, batch by batch: (id, n_tokens, ids, decoded)."""
    encode, decode = _encoding(path, id_col), _decoding(path, id_col)
    schema = StructType([docs.schema[id_col], *_FIELDS, StructField("decoded", BinaryType())])
    return docs.select(id_col, text).mapInArrow(lambda batches: decode(encode(batches)), schema)
