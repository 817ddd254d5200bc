"""Blocks of documents and the packed exchange that the corpus-wide operators share.

A *block* is the set of rows whose ``xxhash64(doc_id)`` falls into one of ``n`` classes.  Blocks are
dealt by one explicit exchange which every later step of the same query reuses, so the texts are
shuffled once, however many rounds an operator needs.

An operator that has to know what the rest of the corpus holds sends *entries* (a 64-bit fingerprint
and, if needed, a payload), each distinct one once per block.  Entries travel packed: one row per
(bucket, block) holds a sorted run of fingerprints, so a hot fingerprint costs one entry per block and
a task never meets a group larger than one bucket.  The answer (one byte per entry, in the same order)
comes back to the block, which recomputes its entries from the text and so knows what each byte means.
"""

from __future__ import annotations

import ctypes
import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block while the corpus is small enough for MOST_BLOCKS of them.
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS, MOST_BLOCKS = 16, 4096
#: Beyond MOST_BLOCKS blocks grow up to this size, then their number grows again.
LARGEST_BLOCK = 64 << 20
#: Bytes of text whose entries meet in a bucket, while there are few buckets, and at most.
BUCKET_BYTES, LARGEST_BUCKET = 4 << 20, 1 << 30
MOST_BUCKETS = 1024
#: Texts are worked on in pieces of about this many bytes.
PIECE = 1 << 20
#: What separates words: fixed values, space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

EXCHANGE_SCHEMA = "bucket int, block int, part int, payload binary"
ANSWER_SCHEMA = "block int, bucket int, part int, answer binary"


def text_bytes(df: DataFrame) -> int:
    """Bytes of column text, counted: Catalyst's estimates multiply at joins and halve at files."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])


def n_blocks(size: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks for a text of so many bytes."""
    return max(min(max(math.ceil(size / block_bytes), LEAST_BLOCKS), MOST_BLOCKS), math.ceil(size / LARGEST_BLOCK))


def n_buckets(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Number of buckets that the entries of a text of so many bytes meet in.  A block sends a row to each, so
    there are far fewer buckets than blocks: rows of the exchange stay few against the entries in them."""
    return max(min(max(math.ceil(size / bucket_bytes), LEAST_BLOCKS), MOST_BUCKETS), math.ceil(size / LARGEST_BUCKET))


def blocked(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """df with column ``block``, dealt by it; a null key is a class of its own."""
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    return df.withColumn("block", block).repartition(n, "block")


def trim() -> None:
    """Gives memory that earlier groups have freed back to the system: Python workers live on, and what
    each has held at most would otherwise stay with it."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


# ---------------------------------------------------------------- numpy on Arrow text


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Runs (first, last) of whole documents of about ``size`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


def stretches(offsets: np.ndarray, overlap: int, size: int = PIECE):
    """Runs (first, last, begin, end, stop) that cover all documents: whole documents of about ``size`` bytes, or
    a part of a longer one.  Strings that start in [begin, end) are the run's own; it reads on up to stop, which
    is ``overlap`` bytes further where the document goes on."""
    for first, last in pieces(offsets, size):
        begin, end = int(offsets[first]), int(offsets[last])
        if last - first > 1 or end - begin <= 2 * size:
            yield first, last, begin, end, end
            continue
        for at in range(begin, end, size):
            yield first, last, at, min(at + size, end), min(at + size + overlap, end)


def word_pieces(raw: np.ndarray, offsets: np.ndarray, size: int = PIECE):
    """Byte ranges (begin, end) of about ``size`` bytes that cut no word: at ends of documents, or in a longer
    document in front of a separator."""
    at, n = 0, len(raw)
    while at < n:
        to = min(at + size, n)
        if to < n:
            whole = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if whole > at:
                to = whole
            else:
                end = int(offsets[np.searchsorted(offsets, to, "right")])
                while to < end and not (found := SPACE[raw[to : min(to + 4096, end)]]).any():
                    to = min(to + 4096, end)
                to = to if to >= end else to + int(np.argmax(found))
        yield at, to
        at = to


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the number of its document."""
    is_word = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], is_word[:-1]]) if len(raw) else is_word
    after = np.concatenate([is_word[1:], [False]]) if len(raw) else is_word
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, end, doc


def coded_words(raw: np.ndarray, offsets: np.ndarray, seeds: tuple[int, ...], table: np.ndarray | None = None):
    """Start, end and document of all words, and for each seed their codes; table maps bytes first (lower case)."""
    found = []
    for a, b in word_pieces(raw, offsets):
        part = raw[a:b] if table is None else table[raw[a:b]]
        low, high = np.searchsorted(offsets, a, "left"), np.searchsorted(offsets, b, "right")
        inner = np.unique(np.concatenate([[0], offsets[low:high] - a, [b - a]]))
        start, end, _ = words(part, inner)
        found.append((start + a, end + a, *(word_codes(part, start, end, s) for s in seeds)))
    cat = lambda i, t: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t)
    start, end = cat(0, np.int64), cat(1, np.int64)
    return start, end, np.searchsorted(offsets, start, "right") - 1, [cat(2 + i, np.uint64) for i in range(len(seeds))]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit codes of words: eight bytes after eight are mixed into a state that the seed and the size begin.
    Every step is a bijection of the state and no sum of bytes, so no pattern of repeated letters cancels out;
    words of one size up to eight bytes never share a code."""
    size = end - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    state = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    state = mix(state ^ (lanes[start] & _LANE[np.minimum(size, 8)]))
    more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        left = size[more] - done
        state[more] = mix(state[more] * np.uint64(0x9FB21C651E98DF25) ^ (lanes[start[more] + done] & _LANE[np.minimum(left, 8)]))
        more, done = more[left > 8], done + 8
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        state[w] = xxhash.xxh3_64_intdigest(raw[start[w] : end[w]].tobytes(), seed)
    return state


def window_keys(codes: np.ndarray, doc: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp fingerprints of all windows of ``width`` words of one document (a polynomial of the words' codes
    in an odd base), and the first word of each."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key *= np.uint64(base)
        key += codes[i : i + n]
    return at, mix(key[at])


@functools.lru_cache(4)
def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Odd bases of rolling fingerprints; seeds take them in turn.
_BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        m = max(n, PIECE + 4096)
        _powers[base] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


class Rolling:
    """Rabin-Karp fingerprints of any span of a byte piece in constant time each.  For spans of up to some
    hundred bytes: words use word_codes()."""

    def __init__(self, raw: np.ndarray, seed: int = 0):
        up, self.down = powers(_BASES[seed % len(_BASES)], len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_codes(seed)[raw] * up[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


# ---------------------------------------------------------------- packing


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


@functools.lru_cache(4)
def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def bucket_bounds(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted 64-bit fingerprints; buckets are equal ranges of them."""
    return np.concatenate([[0], np.searchsorted(sorted_keys, _edges(buckets), "left"), [len(sorted_keys)]])


def frame(*blobs: bytes) -> bytes:
    head = np.array([len(blobs), *map(len, blobs)], np.int64).tobytes()
    return head + b"".join(blobs)


def unframe(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [data[e - s : e] for e, s in zip(ends, sizes, strict=True)]


def entry_rows(block: int, part: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows of EXCHANGE_SCHEMA for entries sorted by key, with a payload array for each of columns."""
    at = bucket_bounds(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    blobs = [frame(pack(deltas(keys[s])), *(pack(c[s]) for c in columns)) for s in (slice(at[b], at[b + 1]) for b in full)]
    n = len(full)
    return pa.table([pa.array(full, pa.int32()), pa.array([block] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block", "part", "payload"])


def resolver(kinds: tuple, decide, part: int):
    """A function for groupBy("bucket").applyInArrow over EXCHANGE_SCHEMA.

    decide(keys, row, columns) gets all entries of a bucket, row being the number of the row each came
    from, and returns a byte for each.
    """

    def run(table: pa.Table) -> pa.Table:
        trim()
        keys, rows, columns = [], [], [[] for _ in kinds]
        for i, blob in enumerate(table.column("payload")):
            head, *rest = unframe(blob.as_py())
            k = np.cumsum(unpack(head, np.uint64), dtype=np.uint64)
            keys.append(k)
            rows.append(np.full(len(k), i, np.int32))
            for c, r, kind in zip(columns, rest, kinds, strict=True):
                c.append(unpack(r, kind))
        sizes = [len(k) for k in keys]
        said = decide(np.concatenate(keys), np.concatenate(rows), [np.concatenate(c) for c in columns])
        answers = [pack(x) for x in np.split(said.astype(np.uint8), np.cumsum(sizes)[:-1])]
        return pa.table([table.column("block"), table.column("bucket"), table.column("part"), pa.array(answers, pa.binary())], names=["block", "bucket", "part", "answer"])

    return run


def answers(table: pa.Table, part: int) -> np.ndarray:
    """The bytes that came back for a block's entries of one part, in key order."""
    rows = sorted((b, a) for b, p, a in zip(*(table.column(c).to_pylist() for c in ("bucket", "part", "answer")), strict=True) if p == part)
    return np.concatenate([unpack(a, np.uint8) for _, a in rows]) if rows else np.zeros(0, np.uint8)


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals [first, end) as disjoint ones in order; those that touch or overlap are one."""
    by = np.argsort(first, kind="stable")
    first, reach = first[by], np.maximum.accumulate(end[by]) if len(by) else end
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1) if len(first) else np.zeros(0, np.int64)
    return first[new], reach[last]


def first_of_runs(*sorted_arrays: np.ndarray) -> np.ndarray:
    """True where any of the arrays, sorted together, changes."""
    n = len(sorted_arrays[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = functools.reduce(np.logical_or, [a[1:] != a[:-1] for a in sorted_arrays])
    return new


#: A null doc_id comes after all others.
LAST = np.iinfo(np.int64).max


def order_of(column) -> np.ndarray:
    """doc_id as an order: null is last."""
    column = column.cast(pa.int64())
    return np.asarray(column.fill_null(int(LAST)).combine_chunks().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.fill_null(int(LAST)).to_numpy(zero_copy_only=False), np.int64)
