"""Deduplication of 100-byte strings by prefix-free parsing (operator 4).

*Parsing.*  A rolling hash of ``TRIGGER`` bytes is kept along each text; a position whose hash is the
leftmost least of the ``REACH`` that follow some position is a trigger.  A phrase reaches from one trigger
past the next one, by the ``REACH + TRIGGER - 1`` bytes that make it the next, so no phrase is a proper
prefix of another; up to ``REACH`` bytes that lead to a trigger, where strings start, are its phrase's lead.
Whether a position is the trigger of a 100-byte string depends on the first ``REACH + TRIGGER - 1`` bytes of
that string alone, so equal strings have their trigger at the same place: a string is a suffix of a
lead (a dictionary suffix) followed by the phrases from its trigger on (a parse suffix).
All strings with the same trigger are neighbours; they form one *context*.

*Round 1* asks for each distinct context of a block whether a smaller doc_id has the very same context, and
whether other contexts share its parse suffix's head.  Inside of repeats, i.e. for nearly all repeated
bytes, this settles every string of the context at once.

*Round 2* is for the edges of repeats, where contexts are equal only in part.  Within a block the distinct
phrases are the dictionary, sorted; the texts are the parse, a sequence of the phrases' ranks.  The suffix
array of the parse comes by prefix doubling over ranks, that of the dictionary's leads by sorting them from
their triggers backwards, both with common prefixes in bytes.  Combined they give the strings of the edge
contexts in corpus order with the places where neighbours differ, so the distinct ones exactly, without a
row of 100 bytes for any.  Each is sent once per block (with the least doc_id), so a passage shared by a
third of all documents costs one entry per block, not one per document.

Blocks are parsed apart, since no task could hold one dictionary of a whole corpus; between blocks contexts
and strings meet by fingerprints with different bases, of 160 and 96 bits in all.

Defined cases: null text is empty; texts shorter than 100 bytes lose nothing; a null doc_id comes after
every other; rows with equal doc_id do not remove each other's bytes; other columns are ignored; an
empty table gives no rows.  Very long texts are fingerprinted in parts of 1 MB that overlap by a string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

LENGTH = 100
REACH = 64
TRIGGER = 10

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = OUT + ", removed array<struct<start:long,end:long>>, kept binary"


class Contexts:
    """The contexts of a piece: trigger, first and last string start, document, fingerprints.  Strings that
    start from byte `own` on are left to the next piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, own: int, length: int, reach: int):
        self.roll = B.Rolling(raw, 3)
        n, span = len(raw), np.diff(offsets)
        self.triggers = self.trigger = self.low = self.high = np.zeros(0, np.int64)
        valid = np.zeros(n + 1, np.int8)  # starts of whole windows
        ok, window = span >= length, reach + TRIGGER - 1
        np.add.at(valid, offsets[:-1][ok], 1)
        np.add.at(valid, offsets[1:][ok] - window + 1, -1)
        valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
        valid[own:] = False
        if valid.any():
            at = np.arange(n - TRIGGER + 1)
            best = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
            best[: len(at)] = (self.roll(at, at + TRIGGER) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
            step, left = 1, reach
            while step < left:  # least of `step` positions, doubled until all `reach` are in
                by = min(step, left - step)
                best[: n - by] = np.minimum(best[: n - by], best[by:])
                step += by
            start = np.flatnonzero(valid)
            trigger = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(B.first_of_runs(trigger, start - np.arange(len(start))))
            self.triggers, low, high = trigger[first], start[first], start[np.append(first[1:], len(start)) - 1]
            # close to a document's end there are triggers of the parse, but no strings
            last = offsets[np.searchsorted(offsets, low, "right")] - length
            some = low <= last
            self.trigger, self.low, self.high = self.triggers[some], low[some], np.minimum(high, last)[some]
        self.doc = np.searchsorted(offsets, self.low, "right") - 1
        shape = ((self.trigger - self.low) * 256 + (self.trigger - self.high)).astype(np.uint64)
        self.key = self.roll(self.low, self.high + length) ^ B.mix(shape + np.uint64(1))
        self.check = (B.Rolling(raw, 4)(self.low, self.high + length) >> np.uint64(32)).astype(np.uint32)
        # every string of a context has this much of the text from the trigger on
        self.head = self.roll(self.trigger, self.trigger + length - reach + 1)


def block_contexts(raw: np.ndarray, offsets: np.ndarray, length: int, reach: int):
    """trigger, low, high, document, key, check and head of all contexts of a block, in order, and the triggers of
    its parse."""
    parts, triggers = [], [np.zeros(0, np.int64)]
    for first, last, begin, end, stop in B.stretches(offsets, length - 1):
        inner = np.minimum(offsets[first : last + 1], stop) - begin
        c = Contexts(raw[begin:stop], np.maximum(inner, 0), end - begin, length, reach)
        parts.append((c.trigger + begin, c.low + begin, c.high + begin, c.doc + first, c.key, c.check, c.head))
        triggers.append(c.triggers + begin)
    if not parts:
        return [np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64, np.uint32, np.uint64, np.int64)]
    return [np.concatenate(x) for x in (*zip(*parts, strict=True), triggers)]


def distinct_contexts(doc, low, key, check, head, order):
    """Entries (sorted by head, key, check), the entry of each context, and which contexts repeat an earlier
    one of their own block: one with a smaller doc_id, or earlier in the same row."""
    by = np.lexsort((low, doc, order[doc], check, key, head))
    k, c, h = key[by], check[by], head[by]
    new = B.first_of_runs(h, k, c)
    first = np.flatnonzero(new)
    entry = np.empty(len(key), np.int64)
    entry[by] = run = np.cumsum(new) - 1
    o, d = order[doc[by]], doc[by]
    least = o[first]
    repeat = np.empty(len(key), bool)
    repeat[by] = (o > least[run]) | ~(new | B.first_of_runs(run, d)) if len(k) else False
    return h[first], k[first], c[first], least, entry, repeat


def _contexts_elsewhere(heads, row, columns):
    """1: a smaller doc_id has the context; 2: other contexts share its head."""
    keys, checks, order = columns
    by = np.lexsort((order, checks, keys, heads))
    h, k, c, o = heads[by], keys[by], checks[by], order[by]
    new = B.first_of_runs(h, k, c)
    first = np.flatnonzero(new)
    least = np.repeat(o[first], np.diff(np.append(first, len(h))))
    group = np.cumsum(B.first_of_runs(h)) - 1
    several = (np.bincount(group[first], minlength=group[-1] + 1) > 1)[group] if len(h) else np.zeros(0, bool)
    out = np.zeros(len(h), np.uint8)
    out[by] = (least < o) + 2 * several
    return out


def _strings_elsewhere(keys, row, columns):
    checks, order = columns
    by = np.lexsort((order, checks, keys))
    k, c, o = keys[by], checks[by], order[by]
    first = np.flatnonzero(B.first_of_runs(k, c))
    least = np.repeat(o[first], np.diff(np.append(first, len(k))))
    out = np.zeros(len(keys), np.uint8)
    out[by] = least < o
    return out


# ---------------------------------------------------------------- dictionary, parse and corpus order


def _rows(raw: np.ndarray, start: np.ndarray, size: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Bytes [start, start + size), or those backwards from start, as rows padded with 0."""
    i = np.arange(max(int(size.max(initial=0)), 1))
    at = start[:, None] - 1 - i if reverse else start[:, None] + i
    out = raw[np.clip(at, 0, len(raw) - 1, out=at)]
    out[i >= size[:, None]] = 0
    return out


def _sorted_distinct(rows: np.ndarray, size: np.ndarray):
    """One of each distinct row in order (shorter ones first where only padding differs), and the rank of each."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    lanes = wide.view(">u8").astype(np.uint64)
    by = np.lexsort((size, *lanes.T[::-1]))
    new = B.first_of_runs(size[by], *lanes[by].T)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    return by[new], rank


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows, at most limit."""
    same = a == b
    return np.minimum(np.where(same.all(1), a.shape[1], np.argmin(same, 1)), limit)


class Parse:
    """The dictionary and the parse of the parts of a block that edge contexts reach.

    begin, end: the phrases in text order; rank: their ranks in the dictionary; one place after each run of
    phrases holds none (rank -1).
    """

    def __init__(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, run: np.ndarray, most: int):
        breaks = np.append(np.flatnonzero(np.diff(run)) + 1, len(run)) if len(run) else np.zeros(0, np.int64)
        place = np.arange(len(run)) + np.searchsorted(breaks, np.arange(len(run)), "right")
        n = len(run) + len(breaks)
        self.place, size = place, end - begin
        self.begin, self.end, self.rank = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
        self.begin[place], self.end[place] = begin, end
        self.rows = _rows(raw, begin, size)
        self.phrases, rank = _sorted_distinct(self.rows, size)
        self.rank[place] = rank
        # suffix array of the parse: order of the next 1, 2, 4, ... phrases
        self.levels = [self.rank + 1]
        while 1 << len(self.levels) - 1 < most:
            step, now = 1 << len(self.levels) - 1, self.levels[-1]
            after = np.concatenate([now[step:], np.zeros(min(step, n), np.int64)])
            after = np.where(now == 0, 0, after)
            self.levels.append(np.unique(now * (n + 2) + after, return_inverse=True)[1].reshape(n) if n else now)
        self.order = np.argsort(self.levels[-1], kind="stable") if n else place

    def suffixes(self):
        """Rank of each place in the order of the parse suffixes, and the common prefix of neighbours in bytes."""
        order = self.order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        p, q = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(p), np.int64)  # phrases in common
        last = len(order) - 1
        for level in range(len(self.levels) - 1, -1, -1):
            now = self.levels[level]
            same = (now[p] == now[q]) & (self.rank[p] >= 0) & (self.rank[q] >= 0)
            step = np.where(same, 1 << level, 0)
            # equal classes may reach past the end of a run: phrases only count up to it
            p, q, shared = np.minimum(p + step, last), np.minimum(q + step, last), shared + step
        first = order[:-1]
        run_end = np.concatenate([np.flatnonzero(self.rank < 0), [last]])
        left = np.minimum(run_end[np.searchsorted(run_end, first)] - first, run_end[np.searchsorted(run_end, order[1:])] - order[1:])
        shared = np.minimum(shared, left)
        a, b = np.minimum(first + shared, last), np.minimum(order[1:] + shared, last)
        over = (self.rank[a] < 0) | (self.rank[b] < 0)
        common = np.where(shared > 0, self.end[np.maximum(a - 1, 0)] - self.begin[first], 0)
        go = np.flatnonzero(~over)
        row = np.zeros(len(self.rank), np.int64)
        row[self.place] = np.arange(len(self.place))
        size = np.minimum(self.end - self.begin, 1 << 30)
        more = _common(self.rows[row[a[go]]], self.rows[row[b[go]]], np.minimum(size[a[go]], size[b[go]]))
        common[go] = self.begin[a[go]] - self.begin[first[go]] + more
        return rank, common


def corpus_order(raw: np.ndarray, offsets: np.ndarray, triggers: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, reach: int):
    """Strings of edge contexts (their triggers are at; triggers: all of the block's parse), each with its class:
    equal class, equal bytes.

    A string of the corpus stands at (dictionary suffix of d bytes before the trigger, parse suffix from it);
    neighbours are equal where both common prefixes reach that far.
    """
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    trigger = np.unique(triggers)  # a long document's parts may share one
    owner = np.searchsorted(offsets, trigger, "right") - 1
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.minimum(np.where(last, len(raw), np.append(trigger[1:], 0) + reach + TRIGGER - 1), offsets[owner + 1])  # of the phrase from each trigger on
    t = np.searchsorted(trigger, at)
    stop = np.searchsorted(trigger, high + length, "left")  # phrases from the trigger up to the context's end
    a, b = B.merged(t, np.maximum(stop, t + 1))
    size = b - a
    ends = np.cumsum(size)
    some = np.repeat(a - (ends - size), size) + np.arange(ends[-1])
    run = np.concatenate([[0], np.cumsum((some[1:] != some[:-1] + 1) | (owner[some[1:]] != owner[some[:-1]]))])
    parse = Parse(raw, trigger[some], end[some], run, int((stop - t).max()) + 1)
    tail_rank, tail_common = parse.suffixes()
    tail = tail_rank[parse.place[np.searchsorted(some, t)]]
    # the dictionary's leads, read backwards from their triggers
    used, lead = np.unique(t, return_inverse=True)
    size = np.minimum(trigger[used] - offsets[owner[used]], reach)
    rows = _rows(raw, trigger[used], size, True)
    distinct, rank = _sorted_distinct(rows, size)
    lead = rank[lead]
    lead_common = _common(rows[distinct[:-1]], rows[distinct[1:]], np.minimum(size[distinct[:-1]], size[distinct[1:]]))
    contexts, starts, kinds, done = [], [], [], 0
    for d in range(reach):
        has = np.flatnonzero((trigger[t] - high <= d) & (trigger[t] - low >= d))
        if not len(has):
            continue
        left = np.concatenate([[0], np.cumsum(lead_common < d)])[lead[has]]
        right = np.concatenate([[0], np.cumsum(tail_common < length - d)])[tail[has]]
        _, kind = np.unique(left * (len(tail_common) + 2) + right, return_inverse=True)
        contexts.append(has)
        starts.append(trigger[t[has]] - d)
        kinds.append(kind + done)
        done += int(kind.max()) + 1
    cat = lambda x: np.concatenate(x) if x else none
    return cat(contexts), cat(starts), cat(kinds)


def edge_strings(raw, offsets, edge, triggers, trigger, low, high, doc, order, length, reach):
    """The strings of edge contexts: entries sorted by fingerprint, and for each string its document, start,
    entry and whether an earlier one of the block equals it."""
    context, start, kind = corpus_order(raw, offsets, triggers, trigger[edge], low[edge], high[edge], length, reach)
    d = doc[edge][context]
    by = np.lexsort((start, d, order[d], kind))
    new = B.first_of_runs(kind[by])
    first = by[new]
    run = np.cumsum(new) - 1
    repeat = np.empty(len(kind), bool)
    o = order[d]
    repeat[by] = (o[by] > o[first][run]) | ~(new | B.first_of_runs(run, d[by])) if len(by) else False
    key, check = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint32)
    at = start[first]
    by_start = np.argsort(at, kind="stable")
    for _, _, begin, end, stop in B.stretches(offsets, length - 1):
        mine = by_start[np.searchsorted(at[by_start], begin) : np.searchsorted(at[by_start], end)]
        if len(mine):
            own = at[mine] - begin
            key[mine] = B.Rolling(raw[begin:stop], 7)(own, own + length)
            check[mine] = B.Rolling(raw[begin:stop], 8)(own, own + length) >> np.uint64(32)
    by_key = np.lexsort((check, key))
    place = np.empty(len(first), np.int64)
    place[by_key] = np.arange(len(first))
    entry = np.empty(len(kind), np.int64)
    entry[by] = place[run]
    return key[by_key], check[by_key], o[first][by_key], d, start, entry, repeat


def removed_bytes(docs: DataFrame, length: int = LENGTH, reach: int = REACH, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text also the removed
    byte intervals and the remaining bytes."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = B.text_bytes(source)
    n, buckets = B.n_blocks(size), B.n_buckets(size)
    text = B.blocked(source, n)
    schema = SPANS if with_text else OUT

    def own(table: pa.Table):
        B.trim()
        raw, offsets = B.flat(table.column("text"))
        order = B.order_of(table.column("doc_id"))
        trigger, low, high, doc, key, check, head, triggers = block_contexts(raw, offsets, length, reach)
        return raw, offsets, order, triggers, trigger, low, high, doc, distinct_contexts(doc, low, key, check, head, order)

    def edges(said, entry, repeat):
        """A context needs its strings looked at one by one if it is not settled as a whole but others
        share its head; contexts settled as a whole have their strings earlier, in one that is."""
        return np.flatnonzero((said[entry] == 2) & ~repeat) if len(said) else np.zeros(0, np.int64)

    def ask_contexts(table: pa.Table) -> pa.Table:
        *_, (heads, keys, checks, least, _, _) = own(table)
        return B.entry_rows(table.column("block")[0].as_py(), 1, buckets, heads, keys, checks, least)

    def ask_strings(key, table: pa.Table, said: pa.Table) -> pa.Table:
        raw, offsets, order, triggers, trigger, low, high, doc, (*_, entry, repeat) = own(table)
        edge = edges(B.answers(said, 1), entry, repeat)
        keys, checks, least, *_ = edge_strings(raw, offsets, edge, triggers, trigger, low, high, doc, order, length, reach)
        return B.entry_rows(key[0].as_py(), 2, buckets, keys, checks, least)

    def finish(key, table: pa.Table, said: pa.Table) -> pa.Table:
        raw, offsets, order, triggers, trigger, low, high, doc, (*_, entry, repeat) = own(table)
        settled = B.answers(said, 1)
        edge = edges(settled, entry, repeat)
        *_, owner, start, string, again = edge_strings(raw, offsets, edge, triggers, trigger, low, high, doc, order, length, reach)
        gone = again | (B.answers(said, 2) > 0)[string] if len(string) else again
        whole = repeat | (settled[entry] & 1 > 0) if len(settled) else repeat
        # intervals of one document merge; documents stand one byte apart meanwhile
        of = np.concatenate([doc[whole], owner[gone]])
        first, end = B.merged(np.concatenate([low[whole], start[gone]]) + of, np.concatenate([high[whole], start[gone]]) + length + of)
        apart = offsets + np.arange(len(offsets))
        bound = np.searchsorted(first, apart)
        sha, kept, spans, lost = [], [], [], []
        for d in range(table.num_rows):
            text_of = raw[offsets[d] : offsets[d + 1]]
            a, b = first[bound[d] : bound[d + 1]] - apart[d], end[bound[d] : bound[d + 1]] - apart[d]
            lost.append(int((b - a).sum()))
            left = np.concatenate([text_of[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text_of)], strict=True)]) if len(a) else text_of
            sha.append(hashlib.sha256(left).hexdigest())
            if with_text:
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                kept.append(left.tobytes())
        out = [table.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(lost, pa.int64()), pa.array(np.diff(bound), pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            out += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            names += ["removed", "kept"]
        return pa.table(out, names=names)

    by_block = text.groupBy("block")
    one = by_block.applyInArrow(ask_contexts, B.EXCHANGE_SCHEMA).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(B.resolver((np.uint64, np.uint32, np.int64), _contexts_elsewhere, 1), B.ANSWER_SCHEMA)
    one = one.repartition(n, "block")
    two = by_block.cogroup(one.groupBy("block")).applyInArrow(ask_strings, B.EXCHANGE_SCHEMA)
    two = two.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(B.resolver((np.uint32, np.int64), _strings_elsewhere, 2), B.ANSWER_SCHEMA)
    said = one.unionByName(two.repartition(n, "block"))
    return by_block.cogroup(said.groupBy("block")).applyInArrow(finish, schema)
