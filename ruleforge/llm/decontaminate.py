"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 8).

A document holds a benchmark item if some part of it is within ``SHARE`` of the item's length in edit
distance (over normalised texts: lower case, letters and digits as words joined by one space, as UTF-8
bytes).  It is found in three steps:

1. *Embedding.*  The CGK random walk reads a window: step j writes the current symbol and moves on by
   r_j(symbol), 0 or 1.  Edit distance between windows becomes Hamming distance between walks.
2. *Repeated bit sampling.*  Each of several walks is sampled at ``SAMPLED`` random places, ``SAMPLES``
   times; a window of a document and a window of an item that agree on all places of a sample are
   candidates.  Windows are sized by the items: items fall into classes by length, a class of length
   L to 2 L has windows of L / 2 bytes, and all items of LARGEST bytes or more those of the class LARGEST,
   so that longer items have more windows, not windows with more edits.  They start at words, and inside of long words or text without
   blanks at every character; all of these in items, the first one in every L / 4 bytes in documents.
   ``recall()`` gives the recall of one window for a number of edits; the defaults give over 0.9
   for a copy with SHARE edits, in every class of length up to 4,095 bytes (asserted in the tests).
3. *Verification.*  Candidates whose whole walks are far apart in Hamming distance go, and those with
   fewer grams of five bytes in common than k edits can leave (a lossless filter); for the others the item's exact
   edit distance to the best part of the document's text around the window decides.

Exact copies are all found, by the fingerprint of an item's first ``SHORT`` bytes at every byte.  Items under
``SHORT`` bytes have no windows: of one with room for k edits, cut into k + 1 pieces, some piece stands unchanged in
every copy, so the grams that begin the pieces find all copies (without loss) and the exact edit distance decides.
Items too short for an edit are looked up exactly, as whole word sequences (characters of scripts without
blanks count as words).  Documents are read once and never shuffled.  Items are read and broadcast in chunks of at
most ``CHUNK`` bytes; a larger benchmark takes several passes.

Defined cases: null or empty texts (also items without a letter or digit) match nothing; null ids stay
null; repeated documents and items are reported each; other columns are ignored; an empty table on
either side gives no rows.  Very long texts are scanned whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SHARE = 0.1
WALKS, SAMPLES, SAMPLED = 2, 8, 8
SHORT = 32
#: Windows do not grow beyond this class: a longer item has more of them, not longer ones with more edits.
LARGEST = 64
CHUNK = 16 << 20
#: Candidates whose walks differ in a greater share of their steps are dropped.
FAR = 0.5
#: Bytes of a word after which windows may start at every character.
RUN = 16
_BITS = 20
#: Bytes of text embedded together, few enough to stay in a core's cache.
PIECE = 1 << 18
#: Windows of a chunk's items, each some 300 bytes of tables.
WINDOWS = 2_000_000

FOUND = "doc_id long, item_id long, distance int, item_bytes int"


def _letters() -> np.ndarray:
    """Bytes of a normalised text: lower-case ASCII letters, digits, and all bytes of other characters."""
    t = np.full(256, 32, np.uint8)
    keep = [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]
    t[keep] = keep
    t[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return t


_LETTER = _letters()


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts normalised, each ended by a 0 byte, and where each begins."""
    n = len(offsets) - 1
    text = np.zeros(len(raw) + n, np.uint8)
    place = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))
    x = _LETTER[raw]
    # capitals of the Latin-1 supplement
    second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1 if len(raw) else np.zeros(0, int)
    x[second] += 0x20
    text[place] = x
    ends = offsets[1:] + np.arange(n)
    text[ends] = 0
    blank = text == 32
    before = np.concatenate([[True], blank[:-1] | (text[:-1] == 0)])
    after = np.concatenate([blank[1:] | (text[1:] == 0), [True]])
    keep = ~(blank & before)  # the first blank of a run stays, none at a text's start
    keep &= ~(blank & after & np.concatenate([text[1:] == 0, [True]]))
    text, stop = text[keep], np.cumsum(keep)[ends]
    # a run of blanks before the end leaves its first one
    tail = np.flatnonzero((text[:-1] == 32) & (text[1:] == 0)) if len(text) else np.zeros(0, int)
    if len(tail):
        stay = np.ones(len(text), bool)
        stay[tail] = False
        stop = np.cumsum(stay)[stop - 1]
        text = text[stay]
    return text, np.concatenate([[0], stop])


class Walk:
    """One random walk of a size class and its samples."""

    def __init__(self, size: int, seed: int):
        r = np.random.default_rng((size, seed))
        self.steps = 2 * size
        odd = lambda n: r.integers(1, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.code = odd(256)
        self.code[0] = 0  # the walk rests at a text's end
        self.factor = odd(self.steps)  # r_j(symbol) is the top bit of the symbol's code times factor j
        self.at: dict[int, list] = {}
        for b in range(SAMPLES):
            for j in r.choice(self.steps, min(SAMPLED, self.steps), replace=False):
                self.at.setdefault(int(j), []).append((b, odd(1)[0]))

    def keys(self, text: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Sampled fingerprints (samples x windows)."""
        n = len(start)
        out, symbols, at = np.zeros((SAMPLES, n), np.uint64), self.code[text], start.astype(np.int64)
        u, v = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for j in range(self.steps):
            np.take(symbols, at, out=u, mode="clip")
            for b, factor in self.at.get(j, ()):
                np.multiply(u, factor, out=v)
                out[b] += v
            np.multiply(u, self.factor[j], out=v)
            np.right_shift(v, np.uint64(63), out=v)
            np.add(at, v.view(np.int64), out=at)
        return out

    def strings(self, text: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The whole embedded strings (steps x windows)."""
        out, at = np.empty((self.steps, len(start)), np.uint8), start.astype(np.int64)
        for j in range(self.steps):
            out[j] = text[at]
            at += ((self.code[out[j]] * self.factor[j]) >> np.uint64(63)).astype(np.int64)
        return out

    def apart(self, text: np.ndarray, start: np.ndarray, other: np.ndarray, which: np.ndarray, steps: int) -> np.ndarray:
        """Share of the first steps in which windows differ from the embedded strings other[:, which]."""
        at, n = start.astype(np.int64), np.zeros(len(start), np.int32)
        for j in range(steps):
            c = text[at]
            n += c != other[j][which]
            at += ((self.code[c] * self.factor[j]) >> np.uint64(63)).astype(np.int64)
        return n / steps


def recall(far: float, samples: int = WALKS * SAMPLES, sampled: int = SAMPLED) -> float:
    """Chance that two windows agree on some sample if their walks differ in a share `far` of the steps."""
    return 1 - (1 - (1 - far) ** sampled) ** samples


def word_starts(text: np.ndarray, begins: np.ndarray):
    """Starts of the words of each text, and the number of the text."""
    word = (text > 32) & np.concatenate([[True], text[:-1] <= 32]) if len(text) else np.zeros(0, bool)
    start = np.flatnonzero(word)
    return start, np.searchsorted(begins, start, "right") - 1


def anchors(text: np.ndarray, begins: np.ndarray, run: int, first: bool = False):
    """Where windows may start, and the number of the text: at words, and inside of words at every character
    from byte `run` on; `first`: at every character of a text's first word too, which other text may precede."""
    at = np.arange(len(text))
    word = np.maximum.accumulate(np.where(text <= 32, at + 1, 0))
    open_ = at - word >= run
    if first:
        open_ |= word == begins[np.searchsorted(begins, word, "right") - 1]
    start = np.flatnonzero((text > 32) & ((at == word) | open_ & (text & 0xC0 != 0x80)))
    return start, np.searchsorted(begins, start, "right") - 1


def one_in(start: np.ndarray, doc: np.ndarray, begins: np.ndarray, every: int):
    """The first of the starts in every `every` bytes of each text."""
    keep = B.first_of_runs(doc, (start - begins[doc]) // every)
    return start[keep], doc[keep]


def edges(text: np.ndarray) -> np.ndarray:
    """Places where a word may begin or end: blanks, ends of texts, and both sides of a character of a script
    that sets no blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese)."""
    second = np.append(text[1:], 0)
    lead = (text >= 0xE3) & (text <= 0xE9) | (text == 0xEA) & (second < 0x93) | (text == 0xEF) & (second >= 0xBC) & (second <= 0xBE) | (text == 0xF0) & (second >= 0xA0) & (second < 0xC0)
    lead |= (text == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (text == 0xE1) & np.isin(second, (0x80, 0x81, 0x82, 0x9E, 0x9F)) | (text == 0xE2) & (second >= 0xBA) & (second < 0xC0)
    begins = text & 0xC0 != 0x80
    own = lead[np.maximum.accumulate(np.where(begins, np.arange(len(text)), 0))]
    return (text <= 32) | begins & (own | np.concatenate([[False], own[:-1]]))


class SizeClass:
    """The hash tables of the items of size to 2 * size bytes, or of all from size = LARGEST on."""

    def __init__(self, size: int, text: np.ndarray, begins: np.ndarray, items: np.ndarray):
        self.size, self.every = size, size // 4
        self.text, self.walks = text, [Walk(size // 2, s) for s in range(WALKS)]
        start, item = anchors(text, begins, RUN // 2, True)
        left = begins[item + 1] - 1 - start
        keep = np.isin(item, items) & (left >= size // 2)
        self.start, self.item = start[keep], item[keep]
        self.offset = self.start - begins[self.item]
        self.strings = [walk.strings(text, self.start) for walk in self.walks]
        self.tables = []
        for walk in self.walks:
            for key in walk.keys(text, self.start):
                by = np.argsort(key, kind="stable")
                hit = np.zeros(1 << _BITS, bool)
                hit[(B.mix(key) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                self.tables.append((key[by], by, hit))

    def candidates(self, text: np.ndarray, begins: np.ndarray, start: np.ndarray, doc: np.ndarray):
        """(document, item, place where the item would begin), each once, from windows at some of the anchors."""
        start, doc = one_in(start, doc, begins, self.every)
        found = []
        for w, walk in enumerate(self.walks):
            for b, key in enumerate(walk.keys(text, start)):
                table, by, hit = self.tables[w * SAMPLES + b]
                some = np.flatnonzero(hit[(B.mix(key) >> np.uint64(64 - _BITS)).astype(np.int64)])
                low, high = np.searchsorted(table, key[some], "left"), np.searchsorted(table, key[some], "right")
                n = high - low
                end = np.cumsum(n)
                own = by[np.repeat(low - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
                found.append(np.stack([np.repeat(some, n), own]))
        n = max(len(self.start), 1)
        pairs = np.unique(np.concatenate([i * n + j for i, j in found]))
        kept = []
        for a in range(0, len(pairs), 20_000):
            i, j = np.divmod(pairs[a : a + 20_000], n)
            # a look at the first steps spares most of the others the rest
            for steps, far in ((24, FAR + 0.1), (2 * (self.size // 2), FAR)):
                near = np.minimum.reduce([w.apart(text, start[i], s, j, steps) for w, s in zip(self.walks, self.strings, strict=True)]) <= far
                i, j = i[near], j[near]
            kept.append(np.stack([i, j]))
        if not kept:
            return np.zeros((0, 3), np.int64)
        i, j = np.concatenate(kept, 1)
        return np.unique(np.stack([doc[i], self.item[j], start[i] - self.offset[j]], 1), axis=0)


#: Length of the grams whose number in common is a lossless filter, and the bits of their codes.
GRAM, GRAM_BITS = 5, 14
#: Items of so many bytes have longer codes, so that few grams agree by chance.
LONG, LONG_GRAM_BITS = 2048, 20


def grams_of(text: np.ndarray) -> np.ndarray:
    """A 32-bit code for every GRAM bytes; its first bits are used."""
    n = len(text) - GRAM + 1
    code, x = np.zeros(max(n, 0), np.uint32), text.astype(np.uint32)
    for i in range(GRAM if n > 0 else 0):
        code = code * np.uint32(0x01000193) + x[i : i + n]
    return code * np.uint32(0x9E3779B1)


def best_distance(item: bytes, text: bytes) -> int:
    """Least edit distance of item to any part of text (bit-parallel dynamic programming)."""
    if item in text:
        return 0
    m = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = where.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        y = eq | minus
        plus, minus = down | (full & ~(y | up)), up & y
    return best


class Matcher:
    """Everything about a chunk of items."""

    def __init__(self, items: list[tuple], share: float = SHARE):
        self.share = share
        self.ids = [i for i, _ in items]
        raw, offsets = B.flat(pa.array([t for _, t in items], pa.string()))
        self.text, self.begins = normalised(raw, offsets)
        data = self.text.tobytes()
        self.items = [data[a : b - 1] for a, b in zip(self.begins[:-1].tolist(), self.begins[1:].tolist(), strict=True)]
        size = np.array([len(t) for t in self.items], np.int64)
        self.grams: dict[int, np.ndarray] = {}
        self.classes = []
        low = SHORT
        while len(size) and low <= min(LARGEST, size.max()):
            own = np.flatnonzero((size >= low) & (size < (2 * low if low < LARGEST else np.inf)))
            if len(own):
                self.classes.append(SizeClass(low, self.text, self.begins, own))
            low *= 2
        #: Items that are not short by the fingerprint of their first SHORT bytes, for exact copies.
        self.long: dict[int, list[int]] = {}
        own = np.flatnonzero(size >= SHORT)
        for i, key in zip(own.tolist(), B.Rolling(self.text, 21)(self.begins[own], self.begins[own] + SHORT).tolist(), strict=True):
            self.long.setdefault(key, []).append(i)
        self.heads = np.array(sorted(self.long), np.uint64)
        self.head_hit = np.zeros(1 << _BITS, bool)
        self.head_hit[(self.heads >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        #: Items without room for an edit, by size; the pieces of other short ones by the code of their first gram;
        #: and those whose pieces are smaller than a gram, which every document is held against.
        self.short: dict[int, dict[bytes, list[int]]] = {}
        self.pieces: dict[int, list[tuple[int, int]]] = {}
        self.scanned: list[int] = []
        for i in np.flatnonzero((size > 0) & (size < SHORT)).tolist():
            item = self.items[i]
            k = int(share * len(item))
            if not k:
                self.short.setdefault(len(item), {}).setdefault(item, []).append(i)
            elif len(item) // (k + 1) < GRAM:
                self.scanned.append(i)
            else:
                codes = grams_of(np.frombuffer(item, np.uint8)) >> np.uint32(32 - _BITS)
                for j in range(k + 1):
                    at = j * len(item) // (k + 1)
                    self.pieces.setdefault(int(codes[at]), []).append((i, at))
        self.piece_hit = np.zeros(1 << _BITS, bool)
        self.piece_hit[list(self.pieces)] = True

    def matches(self, column) -> list[tuple[int, int, int]]:
        """(row, item, distance) for every item that a row's text holds."""
        B.trim()
        raw, offsets = B.flat(column)
        out: list[tuple] = []
        for a, b in B.pieces(offsets, PIECE):
            text, begins = normalised(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out += [(d + a, i, k) for d, i, k in self._piece(text, begins)]
        return out

    def _piece(self, text, begins):
        data, best, grams = text.tobytes(), {}, grams_of(text)
        roll = B.Rolling(text, 21)
        if len(self.heads) and len(text) > SHORT:
            n = len(text) - SHORT + 1
            keys = roll(np.arange(n), np.arange(n) + SHORT)
            some = np.flatnonzero(self.head_hit[(keys >> np.uint64(64 - _BITS)).astype(np.int64)])
            some = some[np.isin(keys[some], self.heads)]
            for at, key, doc in zip(some.tolist(), keys[some].tolist(), (np.searchsorted(begins, some, "right") - 1).tolist(), strict=True):
                for item in self.long[key]:
                    if data.startswith(self.items[item], at):
                        best[doc, item] = 0
        start, owner = anchors(text, begins, RUN) if self.classes else (None, None)
        for c in self.classes:
            for doc, item, low, high in self._parts(c.candidates(text, begins, start, owner), begins):
                want = self.items[item]
                k = int(self.share * len(want))
                if best.get((doc, item), k + 1) == 0:
                    continue
                bits = GRAM_BITS if len(want) < LONG else LONG_GRAM_BITS
                if (own := self.grams.get(item)) is None:
                    self.grams[item] = own = np.zeros(1 << bits, bool)
                    own[grams_of(np.frombuffer(want, np.uint8)) >> np.uint32(32 - bits)] = True
                if np.count_nonzero(own[grams[low : high - GRAM + 1] >> np.uint32(32 - bits)]) < len(want) - GRAM + 1 - GRAM * k:
                    continue
                d = best_distance(want, data[low:high])
                if d <= k:
                    best[doc, item] = min(d, best.get((doc, item), d))
        if self.pieces:
            codes = grams >> np.uint32(32 - _BITS)
            some = np.flatnonzero(self.piece_hit[codes])
            for at, code, doc in zip(some.tolist(), codes[some].tolist(), (np.searchsorted(begins, some, "right") - 1).tolist(), strict=True):
                for item, offset in self.pieces[code]:
                    want = self.items[item]
                    if data.startswith(want[offset : offset + GRAM], at):
                        k = int(self.share * len(want))
                        *_, low, high = self._within((doc, item, at - offset - k, at - offset + len(want) + k, 0), begins)
                        if (d := best_distance(want, data[low:high])) <= k:
                            best[doc, item] = min(d, best.get((doc, item), d))
        for item in self.scanned:
            want = self.items[item]
            for doc, (low, high) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                if (d := best_distance(want, data[low : high - 1])) <= int(self.share * len(want)):
                    best[doc, item] = d
        if self.short:
            edge = edges(text)
            start = np.flatnonzero((text > 32) & (edge | np.concatenate([[True], text[:-1] <= 32])))
            doc = np.searchsorted(begins, start, "right") - 1
            for size, items in self.short.items():
                fits = np.flatnonzero(start + size < begins[doc + 1])
                fits = fits[edge[start[fits] + size]]
                keys = roll(start[fits], start[fits] + size)
                own = b"".join(items)
                known = B.Rolling(np.frombuffer(own, np.uint8), 21)(np.arange(len(items)) * size, (np.arange(len(items)) + 1) * size)
                for f in fits[np.isin(keys, known)].tolist():
                    for item in items.get(data[start[f] : start[f] + size], ()):
                        best[int(doc[f]), item] = 0
        return [(d, i, k) for (d, i), k in sorted(best.items())]

    def _parts(self, found: np.ndarray, begins: np.ndarray):
        """(document, item, first byte, end) of the parts of documents to hold against items; parts less than
        the allowed edits apart are one."""
        last = None
        for doc, item, at in found.tolist():
            n = len(self.items[item])
            k = int(self.share * n)
            if last and last[:2] == (doc, item) and at - k <= last[4] + k:
                last = (*last[:3], at + n + k, at)
                continue
            if last:
                yield self._within(last, begins)
            last = (doc, item, at - k, at + n + k, at)
        if last:
            yield self._within(last, begins)

    @staticmethod
    def _within(part: tuple, begins: np.ndarray) -> tuple[int, int, int, int]:
        doc, item, low, high, _ = part
        return doc, item, max(int(begins[doc]), low), min(int(begins[doc + 1]) - 1, high)


def _chunks(benchmark: DataFrame):
    """The items in chunks of at most CHUNK bytes, each small enough to broadcast; one at a time is read."""
    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # at most one window for an ASCII word's last eight bytes and for every other character
    windows = F.length(F.regexp_replace("text", "[!-~]{1,8}(?![!-~])", "."))
    total, most = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(windows), F.lit(0))).first()
    n = max(1, math.ceil(2 * total / CHUNK), math.ceil(most / WINDOWS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r.item_id, r.text) for r in source.where(part == i).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """A row for every document and item that it holds, with their edit distance."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for chunk in _chunks(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(chunk)

        def run(batches, items=items):
            matcher = Matcher(items.value, share)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = matcher.matches(batch.column(1))
                columns = [[ids[d] for d, _, _ in found], [matcher.ids[i] for _, i, _ in found], [k for _, _, k in found], [len(matcher.items[i]) for _, i, _ in found]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "item_bytes"])

        parts.append(source.mapInArrow(run, FOUND))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the rows that hold an item; all columns as they are."""
    for chunk in _chunks(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(chunk)

        def run(batches, items=items):
            matcher = Matcher(items.value, share)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, _, _ in matcher.matches(batch.column(batch.schema.get_field_index("text")))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
