"""Byte-level BPE encoding and decoding over a global shuffle of distinct words (operator 1).

1. Each task splits its texts into pre-tokens.  A block of about ``BLOCK_TOKENS`` pre-tokens keeps, per
   document, the positions as numbers into the block's own list of distinct words (frequent words get
   small numbers, so the list packs well).
2. Every distinct word of a block goes to the bucket that its hash names; there each distinct word of
   the corpus is encoded once, and its ids go back to the blocks that asked.  A word that stands in
   every document costs one entry per block.
3. A block joins the ids to its positions, reassembles them in order, and decodes by looking every id
   up in the token-byte table.

Positions and words leave step 1 in one exchange, read by both later steps, so texts are read and split
once and never shuffled.

Defined cases: null text is empty and has no tokens; a null doc_id stays null; repeated rows are encoded
each; other columns are ignored; an empty table gives no rows.  Very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: The pattern that splits a text before the merges; a fixed value of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 4_000_000
#: Texts of more characters are split lazily, so that their pre-tokens never stand in memory together.
LONG = 4_000_000

WORDS_SCHEMA = "key long, block long, payload binary"
IDS_SCHEMA = "block long, payload binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, n_tokens long, ids array<int>"


def vocabulary(path: str) -> bytes:
    """The rank file's bytes: under a megabyte whatever the corpus, so it is safe to broadcast."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(2)
def encoder(ranks: bytes, pattern: str = PATTERN):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(2)
def token_bytes(ranks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes one after another, and where each begins."""
    rows = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines()))
    size = np.zeros(rows[-1][0] + 1, np.int64)
    for i, t in rows:
        size[i] = len(t)
    return np.frombuffer(b"".join(t for _, t in rows), np.uint8), np.concatenate([[0], np.cumsum(size)])


def gather(values: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[start[i]:start[i + 1]]`` for i in which, joined, and the end of each."""
    size = start[which + 1] - start[which]
    end = np.cumsum(size)
    shift = start[which] - (end - size)
    return values[np.repeat(shift, size) + np.arange(end[-1] if len(end) else 0)], end


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _block_rows(block: int, buckets: int, doc_ids: list, sizes: list, numbers: list, words: _Numbers) -> pa.RecordBatch:
    local = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
    by_count = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.uint32)
    place[by_count] = np.arange(len(words), dtype=np.uint32)
    spelled = [w.encode() for w in words]
    ordered = [spelled[i] for i in by_count]
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    none = np.array([d is None for d in doc_ids], np.uint8)
    keys, payloads = [block], [B.frame(B.pack(ids), B.pack(none), B.pack(np.array(sizes, np.int64)), B.pack(place[local]))]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in ordered), np.int64, len(ordered))
    by_bucket = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(at)).tolist():
        mine = by_bucket[at[b] : at[b + 1]]
        own = [ordered[i] for i in mine.tolist()]
        size = np.fromiter(map(len, own), np.uint32, len(own))
        keys.append(-1 - b)
        payloads.append(B.frame(B.pack(np.diff(mine, prepend=0).astype(np.uint32)), B.pack(size), zstandard.ZstdCompressor(level=1).compress(b"".join(own))))
    return pa.record_batch([pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array(payloads, pa.binary())], names=["key", "block", "payload"])


def _splitter(pattern: str, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        find, n_block = regex.compile(pattern), 0
        doc_ids, sizes, numbers, words, held = [], [], [], _Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = find.findall(text) if len(text) < LONG else (m[0] for m in find.finditer(text))
                own = np.fromiter(map(words.__getitem__, found), np.uint32)
                doc_ids.append(doc_id)
                sizes.append(len(own))
                numbers.append(own)
                held += len(own) + 1
                if held >= BLOCK_TOKENS:
                    yield _block_rows((part << 32) + n_block, buckets, doc_ids, sizes, numbers, words)
                    doc_ids, sizes, numbers, words, held = [], [], [], _Numbers(), 0
                    n_block += 1
                    B.trim()
        if doc_ids:
            yield _block_rows((part << 32) + n_block, buckets, doc_ids, sizes, numbers, words)

    return run


def _encode_words(ranks, pattern: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        B.trim()
        blocks, payloads = [], []
        if key[0].as_py() < 0:
            known: dict[bytes, list[int]] = {}
            encode = encoder(ranks.value, pattern)._encode_single_piece
            for block, blob in zip(table.column("block").to_pylist(), table.column("payload"), strict=True):
                which, sizes, spelled = B.unframe(blob.as_py())
                spelled, at, ids, counts = zstandard.ZstdDecompressor().decompress(spelled), 0, [], []
                for end in np.cumsum(B.unpack(sizes, np.uint32), dtype=np.int64).tolist():
                    word = spelled[at:end]
                    if (own := known.get(word)) is None:
                        known[word] = own = encode(word)
                    ids += own
                    counts.append(len(own))
                    at = end
                blocks.append(block)
                payloads.append(B.frame(which, B.pack(np.array(counts, np.uint32)), B.pack(np.array(ids, np.uint32))))
        return pa.table([pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())], names=["block", "payload"])

    return run


def _assemble(ranks, digest: bool):
    def run(key, table: pa.Table, encoded: pa.Table) -> pa.Table:
        B.trim()
        doc_ids, counts, ids_out, decoded_out = [], [], [], []
        if key[0].as_py() >= 0:
            ids, none, sizes, local = B.unframe(table.column("payload")[0].as_py())
            doc_ids = [None if n else i for i, n in zip(B.unpack(ids, np.int64).tolist(), B.unpack(none, np.uint8).tolist(), strict=True)]
            end_of = np.cumsum(B.unpack(sizes, np.int64))
            local = B.unpack(local, np.uint32)
            which, size, flat = [], [], []
            for blob in encoded.column("payload"):
                w, c, i = B.unframe(blob.as_py())
                which.append(np.cumsum(B.unpack(w, np.uint32), dtype=np.int64))
                size.append(B.unpack(c, np.uint32).astype(np.int64))
                flat.append(B.unpack(i, np.uint32))
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            which, size, flat = cat(which, np.int64), cat(size, np.int64), cat(flat, np.uint32)
            # words come bucket by bucket: row[n] is where word n of the block stands among them
            row = np.empty(len(which), np.int64)
            row[which] = np.arange(len(which))
            start = np.concatenate([[0], np.cumsum(size)])
            data, begins = token_bytes(ranks.value)
            at = 0
            for end in end_of.tolist():
                own, _ = gather(flat, start, row[local[at:end]])
                counts.append(len(own))
                if digest:
                    ids_out.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    decoded_out.append(hashlib.sha256(gather(data, begins, own.astype(np.int64))[0].tobytes()).hexdigest())
                else:
                    ids_out.append(own.astype(np.int32))
                at = end
        out = [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64())]
        if digest:
            return pa.table([*out, pa.array(ids_out, pa.string()), pa.array(decoded_out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.table([*out, pa.array(ids_out, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_tokens, ids; with digest, SHA-256 of the ids as little-endian
    unsigned 32-bit integers and of the bytes they decode to, instead of the ids."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(vocabulary(path))
    buckets = B.n_buckets(B.text_bytes(source), 16 << 20)
    split = source.mapInArrow(_splitter(pattern, buckets), WORDS_SCHEMA).repartition(buckets * 2, "key")
    encoded = split.groupBy("key").applyInArrow(_encode_words(ranks, pattern), IDS_SCHEMA).repartition(buckets * 2, "block")
    return split.groupBy("key").cogroup(encoded.groupBy("block")).applyInArrow(_assemble(ranks, digest), DIGESTS if digest else IDS)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (doc_id, ids) as doc_id, decoded (binary), by the token-byte table; null ids decode to no bytes."""
    ranks = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        data, begins = token_bytes(ranks.value)
        for batch in batches:
            rows = [gather(data, begins, np.array(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")
