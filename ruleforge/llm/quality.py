"""Quality classifier by attention-based multiple-instance learning (operator 3).

A document is a bag of passages.  Every passage is encoded (numbers about its characters, words and
repetition, then one hidden layer); gated attention weighs the passages, and the weighted passage
representation is scored.  Only documents have labels: the attention is learned through them.

The model is fitted on the driver from a bounded sample of labelled rows: those with the least hash of doc_id,
at most ``SAMPLE`` of them and only as many as hold ``PASSAGES`` passages together (documented bounds).  Each
takes part with all its passages.  Scoring encodes every passage of every document.

Defined cases: null or empty text is a bag of one empty passage and gets a score too; a null doc_id is
scored and not held out; labels that are null or not 0 or 1 teach nothing, repeated ones count each; of rows
with equal doc_id one teaches (that with the least hash of its text);
without labels of both kinds every score is the share of label 1 (0.5 without labels); repeated rows
are scored each; other columns are no input of a score; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

SAMPLE, PASSAGES = 3000, 40_000
#: A passage ends with the first word after this many bytes.
PASSAGE = 600
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4

OUT = "doc_id long, held_out boolean, score double, predicted int"

#: Classes of bytes that are counted, as ranges; fixed values.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"\"'()[]{}", b"|", b"#$%&*+/<=>@\\^_`~-")
N_FEATURES = len(CLASSES) + 1 + 9


def _table() -> np.ndarray:
    kind = np.full(256, len(CLASSES), np.uint8)  # the last: bytes of other characters
    for i, c in enumerate(CLASSES):
        kind[list(c)] = i
    return kind


_KIND = _table()


def encode_passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the number of its document; every document has one at least."""
    n_docs = len(offsets) - 1
    start, end, doc = B.words(raw, offsets)
    number = (start - offsets[doc]) // PASSAGE
    new = B.first_of_runs(doc, number)
    first = np.flatnonzero(new)
    empty = np.setdiff1d(np.arange(n_docs), doc[first])
    owner = np.concatenate([doc[first], empty])
    x = np.zeros((len(owner), N_FEATURES), np.float32)
    if len(first):
        last = np.append(first[1:], len(start)) - 1
        low, high = start[first], np.where(np.append(doc[first][1:] == doc[first][:-1], False), np.append(start[first][1:], 0), offsets[doc[first] + 1])
        size = np.maximum(high - low, 1).astype(float)
        kinds = _KIND[raw]
        counts = np.empty((len(first), len(CLASSES) + 1))
        for k in range(len(CLASSES) + 1):
            sums = np.concatenate([[0], np.cumsum(kinds == k)])
            counts[:, k] = sums[high] - sums[low]
        m = len(CLASSES) + 1
        x[: len(first), :m] = counts / size[:, None]
        n_words = (last - first + 1).astype(float)
        length = (end - start).astype(float)
        key = B.word_codes(raw, start, end, 5)
        passage = np.cumsum(new) - 1
        again = (np.append(False, key[1:] == key[:-1]) & ~new).astype(float)
        by = np.lexsort((key, passage))
        distinct = np.bincount(passage[by][B.first_of_runs(passage[by], key[by])], minlength=len(first))
        shout = (np.isin(kinds[start], (1,)) & np.isin(kinds[np.maximum(end - 1, start)], (1, 7))).astype(float)
        mark = np.isin(kinds[end - 1], (9, 10)).astype(float)
        mean = lambda v: np.add.reduceat(v, first) / n_words
        own = mean(length)
        x[: len(first), m:] = np.stack([
            own / 10, np.sqrt(np.maximum(mean(length**2) - own**2, 0)) / 10, mean(again), distinct / n_words, mean(shout), mean(mark),
            np.log1p(n_words) / 5, np.log1p(offsets[doc[first] + 1] - offsets[doc[first]]) / 12, mean((length == 1).astype(float)),
        ], 1)
    by = np.argsort(owner, kind="stable")
    return x[by], owner[by]


def _features(table) -> tuple[np.ndarray, np.ndarray]:
    B.trim()
    raw, offsets = B.flat(table)
    found = []
    for a, b in B.pieces(offsets):
        x, owner = encode_passages(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append((x, owner + a))
    if not found:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Attention:
    """score(bag) = sigmoid(c . sum_i a_i h_i + d), a = softmax(w . (tanh(V h) * sigmoid(U h))), h = tanh(A x + b)."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"A": r.normal(0, 0.3, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, cut off where a very short passage would leave what was seen."""
        return np.clip((x - self.mean) / self.scale, -3, 3)

    def forward(self, x, owner, n):
        """owner is sorted and names every bag."""
        p = self.p
        h = np.tanh(self.scaled(x) @ p["A"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        at = np.searchsorted(owner, np.arange(n))
        e = np.exp(s - np.maximum.reduceat(s, at)[owner])
        a = e / np.add.reduceat(e, at)[owner]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return h, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30))), at

    def gradient(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy by every parameter."""
        p = self.p
        h, v, u, a, z, score, at = self.forward(x, owner, len(y))
        d = weight * (score - y) / len(y)
        dz = (d[:, None] * p["c"])[owner]
        da = (dz * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, at)[owner])
        dv, du = ds[:, None] * p["w"] * u * (1 - v * v), ds[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"A": self.scaled(x).T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": z.T @ d, "d": np.array([d.sum()])}

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> Attention:
        self.constant = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return self
        self.constant = None
        self.mean, self.scale = x.mean(0).astype(float), x.std(0).astype(float) + 1e-3
        p = self.p
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        weight = 0.5 * weight + 0.5  # half way to balance, so that 0.5 stays near the even odds
        first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, STEPS + 1):
            g = self.gradient(x, owner, y, weight)
            for k in p:
                grad = g[k] + DECAY * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None or not n:
            return np.full(n, 0.5 if self.constant is None else self.constant)
        return self.forward(x, owner, n)[5]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _pool(batches):
    for batch in batches:
        x, owner = _features(batch.column(0))
        bound = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(bound, bound[1:], strict=False)]
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(np.diff(bound), pa.int64()), pa.array(rows, pa.binary())], names=["quality", "place", "passages", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES) -> Attention:
    """The model from a bounded sample of the labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # `sample` numbers at most
    one = wanted.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("doc_id", "least.text")
    rows = one.join(F.broadcast(chosen), "doc_id").select("text", "quality", F.struct(F.xxhash64("doc_id"), "doc_id", "quality").alias("place"))
    rows = rows.mapInArrow(_pool, "quality int, place struct<h:long,doc_id:long,quality:int>, passages long, x binary")
    upto = F.sum("passages").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))  # `sample` rows at most
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= passages).orderBy("place").select("quality", "x").collect()
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in rows]
    y = np.array([r.quality for r in rows], float)
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return Attention().fit(x.astype(float), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)


def score(docs: DataFrame, model: Attention, column: str = "score") -> DataFrame:
    """docs with the model's score; all columns stay."""
    import pyspark.sql.types as T

    def run(batches):
        for batch in batches:
            x, owner = _features(batch.column(batch.schema.get_field_index("text")))
            yield pa.record_batch([*batch.columns, pa.array(model.score(x.astype(float), owner, batch.num_rows), pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    model = fit(docs, labels)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(source, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
