"""Substring deduplication over windows of 13 words (operator 7).

Rabin-Karp fingerprints of every window of ``width`` consecutive words are counted over the corpus;
windows whose word sequence also starts in a document with a smaller doc_id are repeated, and repeated
windows of a document merge into maximal intervals of words, which are removed.

Two rounds of the packed exchange (see blocks.py):

1. every distinct fingerprint of a block, cut to 48 bits, asks whether it occurs in another document at
   all (windows that only share these bits are sorted out next);
2. only those that do ask again, with a second fingerprint (other codes of the words, another base) and the
   block's smallest doc_id, whether a smaller doc_id has the window.  So a window is removed on 112 agreeing
   bits; the words' codes are no sums of their letters (see blocks.word_codes).

Defined cases: null text has no words; an empty text or one with fewer than ``width`` words loses
nothing; a null doc_id comes after every other; rows with equal doc_id never remove each other's
words, but are both judged against smaller ids; other columns are ignored; an empty table gives no
rows.  Very long texts are worked on whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WIDTH = 13
#: Seeds of the words' codes and odd bases of the two fingerprints.
SEEDS, BASES = (1, 2), (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)
#: The bits of a fingerprint that the first round sends.
COARSE = np.uint64(0xFFFFFFFFFFFF0000)

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept string"


def _block_windows(table: pa.Table, width: int):
    """The words of a block, and its windows: first word, both fingerprints and document of each."""
    B.trim()
    raw, offsets = B.flat(table.column("text"))
    start, end, doc, codes = B.coded_words(raw, offsets, SEEDS)
    at, one = B.window_keys(codes[0], doc, width, BASES[0])
    two = B.window_keys(codes[1], doc, width, BASES[1])[1]
    return raw, offsets, start, end, doc, at, one & COARSE, two, doc[at]


def without(raw: np.ndarray, start: np.ndarray, end: np.ndarray, covered: np.ndarray) -> bytes:
    """A document's words that are not covered, joined by one space; raw, start and end are its own."""
    keep = np.flatnonzero(~covered)
    if not len(keep):
        return b""
    first, last = start[keep], end[keep]
    step = np.zeros(len(raw) + 2, np.int8)
    step[first] += 1
    step[last + 1] -= 1  # one separator goes with each word
    out = raw.copy()
    out[last[:-1]] = 0x20
    return out[np.cumsum(step[: len(raw)], dtype=np.int8) > 0].tobytes()[: int((last - first).sum()) + len(keep) - 1]


def _distinct(key: np.ndarray, order: np.ndarray):
    """Distinct keys sorted, the smallest and largest doc order of each, and each window's entry."""
    by = np.lexsort((order, key))
    k, o = key[by], order[by]
    new = B.first_of_runs(k)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1 if len(k) else first
    entry = np.empty(len(key), np.int64)
    entry[by] = np.cumsum(new) - 1
    return k[first], o[first], o[last] if len(k) else o, entry


def _round_two(one, two, order, said):
    """Windows that some other document has too, and their distinct entries."""
    keys, low, high, entry = _distinct(one, order)
    again = np.flatnonzero(((said > 0) | (low != high))[entry]) if len(keys) else np.zeros(0, np.int64)
    return again, _distinct(B.mix(one[again] ^ two[again] * np.uint64(0x9E3779B97F4A7C15)), order[again])


def _elsewhere(keys, row, columns):
    """Round 1: has another block the fingerprint?"""
    by = np.argsort(keys, kind="stable")
    k = keys[by]
    new = B.first_of_runs(k)
    run = np.cumsum(new) - 1
    out = np.zeros(len(keys), np.uint8)
    out[by] = (np.bincount(run)[run] > 1) if len(k) else 0
    return out


def _smaller(keys, row, columns):
    """Round 2: has another block the fingerprint in a document with a smaller doc_id?"""
    (order,) = columns
    by = np.lexsort((order, keys))
    k, o = keys[by], order[by]
    first = np.flatnonzero(B.first_of_runs(k))
    least = np.repeat(o[first], np.diff(np.append(first, len(k))))
    out = np.zeros(len(keys), np.uint8)
    out[by] = least < o
    return out


def removed_words(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, and with_text also the removed word
    intervals and the kept text (words joined by one space)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = B.text_bytes(source)
    n, buckets = B.n_blocks(size), B.n_buckets(size)
    text = B.blocked(source, n)
    schema = OUT if with_text else "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def ask_once(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        one = _block_windows(table, width)[6]
        return B.entry_rows(block, 1, buckets, np.unique(one))

    def ask_again(key, table: pa.Table, said: pa.Table) -> pa.Table:
        order = B.order_of(table.column("doc_id"))
        *_, one, two, doc = _block_windows(table, width)
        _, (keys, low, _, _) = _round_two(one, two, order[doc], B.answers(said, 1))
        return B.entry_rows(key[0].as_py(), 2, buckets, keys, low)

    def finish(key, table: pa.Table, said: pa.Table) -> pa.Table:
        order = B.order_of(table.column("doc_id"))
        raw, offsets, start, end, doc_of_word, at, one, two, doc = _block_windows(table, width)
        again, (keys, low, _, entry) = _round_two(one, two, order[doc], B.answers(said, 1))
        gone = (B.answers(said, 2) > 0)[entry] | (order[doc[again]] > low[entry]) if len(keys) else np.zeros(0, bool)
        first = at[again[gone]]
        covered = np.zeros(len(start), bool)
        for a, b in zip(*(x.tolist() for x in B.merged(first, first + width)), strict=True):
            covered[a:b] = True
        m = table.num_rows
        bound = np.searchsorted(doc_of_word, np.arange(m + 1))
        total, lost = np.diff(bound), []
        sha, kept_texts, spans = [], [], []
        for d in range(m):
            a, b = bound[d], bound[d + 1]
            own = covered[a:b]
            lost.append(int(np.count_nonzero(own)))
            kept = without(raw[offsets[d] : offsets[d + 1]], start[a:b] - offsets[d], end[a:b] - offsets[d], own)
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode("utf-8", "replace"))
                c = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(c > 0), np.flatnonzero(c < 0), strict=True)])
        out = [table.column("doc_id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            out += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept_texts, pa.string())]
            names += ["removed", "kept"]
        return pa.table(out, names=names)

    by_block = text.groupBy("block")
    once = by_block.applyInArrow(ask_once, B.EXCHANGE_SCHEMA).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(B.resolver((), _elsewhere, 1), B.ANSWER_SCHEMA)
    once = once.repartition(n, "block")
    again = by_block.cogroup(once.groupBy("block")).applyInArrow(ask_again, B.EXCHANGE_SCHEMA)
    again = again.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(B.resolver((np.int64,), _smaller, 2), B.ANSWER_SCHEMA)
    said = once.unionByName(again.repartition(n, "block"))
    return by_block.cogroup(said.groupBy("block")).applyInArrow(finish, schema)
