"""Entity matching: embeddings, hashing, clustering of similarity vectors, entity ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column, kind: str = "euclidean") -> Column:
    """euclidean, squared (the same without the root), centred (of vectors less their means), cosine, l1."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    squared = _sum(F.transform(gap, lambda x: x * x))
    if kind == "cosine":
        return 1 - cosine(a, b)
    if kind == "l1":
        return _sum(F.transform(gap, F.abs))
    if kind == "centred":
        mean = _sum(gap) / F.size(gap)
        return _sum(F.transform(gap, lambda x: (x - mean) * (x - mean)))
    return squared if kind == "squared" else F.sqrt(squared)


#: Rows of a part of a block, and pairs that a task scores at once.
MATCH_ROWS, MATCHED_AT_ONCE = 16_384, 1 << 21


def _ids(column) -> np.ndarray:
    """Row ids of an Arrow column; numbers stay numbers, others are objects."""
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array([*column.to_pylist(), None], object)[:-1]


def embedding_matches(df: DataFrame, tid: str, vector: str, threshold: float, block: str) -> DataFrame:
    """Pairs (a < b) of one block whose cosine, rounded to six digits, exceeds threshold.

    The parts of a block meet each other, each pair of parts in one task, as products of matrices; the cosines of the
    pairs that come near the threshold are then summed up term by term.  Vectors meet those of their own length;
    null vectors, and those with a null component, meet none.
    """
    kind = dict(df.dtypes)[tid]

    def matrix(t: pa.Table):
        rows = t.column("vector").combine_chunks()
        m = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1)
        norm = np.zeros(len(m))
        for x in m.T:
            norm = norm + x * x
        return m, np.sqrt(norm), _ids(t.column("id"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        itself = key[2] == key[3]
        left = matrix(t.filter(pa.compute.equal(t.column("part"), key[2])))
        (m, u, a), (n, v, b) = left, left if itself else matrix(t.filter(pa.compute.equal(t.column("part"), key[3])))
        id_type = t.schema.field("id").type
        step = max(1, MATCHED_AT_ONCE // max(len(n), 1))
        for s in range(0, len(m), step):
            base = s if itself else 0  # a part meets its own rows from here on
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                near = m[s : s + step] @ n[base:].T / (u[s : s + step, None] * v[base:])
            x, y = np.nonzero(~(near < threshold - 2e-6))
            x, y = x + s, y + base
            ok = (u[x] * v[y] != 0) & (a[x] != b[y]).astype(bool)
            if itself:
                ok &= x < y
            x, y = x[ok], y[ok]
            dot = np.zeros(len(x))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                for p, q in zip(m.T, n.T, strict=True):
                    dot = dot + p[x] * q[y]
                found = dot / (u[x] * v[y])
            turned = (a[x] > b[y]).astype(bool)
            yield pa.record_batch([pa.array(np.where(turned, b[y], a[x]), id_type), pa.array(np.where(turned, a[x], b[y]), id_type), pa.array(found)], names=["a", "b", "cosine"])

    rows = df.where(F.col(tid).isNotNull() & F.col(block).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & (F.size(vector) > 0))
    rows = rows.select(F.col(tid).alias("id"), F.col(block).alias("block"), F.size(vector).alias("size"), F.col(vector).alias("vector"))
    parts = rows.groupBy("block", "size").agg(F.ceil(F.count("*") / MATCH_ROWS).cast("int").alias("parts"))
    cells = int(parts.agg(F.sum(F.col("parts").cast("long") * (F.col("parts") + 1) / 2)).first()[0] or 1)
    part = F.pmod(F.xxhash64("id", F.lit(31)), F.col("parts")).cast("int")
    dealt = rows.join(parts, ["block", "size"]).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("id", "block", "size", "vector", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    key = ("block", "size", "i", "j")
    found = dealt.repartition(min(2 * cells, 100_000), *key).groupBy(*key).applyInArrow(run, f"a {kind}, b {kind}, cosine double")
    return found.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") > threshold)


def hyperplanes(bits: int, tables: int, dimensions: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dimensions))


def superbit(bits: int, tables: int, dimensions: int, seed: int = 1) -> np.ndarray:
    """Random planes made orthogonal in groups of at most as many as there are dimensions."""
    planes = hyperplanes(bits, tables, dimensions, seed)
    for t in range(tables):
        for b in range(0, bits, dimensions):
            q, _ = np.linalg.qr(planes[t, b : b + dimensions].T)
            planes[t, b : b + q.shape[1]] = q.T
    return planes


def signatures(vector: Column, planes: np.ndarray) -> Column:
    """One integer a table: the signs of the projections as bits."""
    rows = []
    for table in planes:
        bits = [F.when(dot(vector, F.array(*[F.lit(float(x)) for x in plane])) > 0, 1 << i).otherwise(0) for i, plane in enumerate(table)]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        rows.append(total)
    return F.array(*rows)


def buckets(df: DataFrame, tid: str, vector: str, planes: np.ndarray) -> DataFrame:
    """tid, table, bucket: projections by one matrix product for each Arrow batch."""
    kind = dict(df.dtypes)[tid]
    flat = planes.reshape(-1, planes.shape[-1])
    weights = 1 << np.arange(planes.shape[1], dtype=np.int64)

    def run(batches):
        for batch in batches:
            ids, tables, codes = [], [], []
            if batch.num_rows:
                m = np.array(batch.column(1).to_pylist(), float)
                code = ((m @ flat.T).reshape(len(m), *planes.shape[:2]) > 0) @ weights
                ids, tables, codes = np.repeat(np.arange(len(m)), code.shape[1]), np.tile(np.arange(code.shape[1]), len(m)), code.ravel()
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(tables, pa.int32()), pa.array(codes, pa.int64())], names=[tid, "table", "bucket"])

    return df.where(F.col(vector).isNotNull()).select(tid, vector).mapInArrow(run, f"{tid} {kind}, table int, bucket long")


#: Rows of a block of queries and of a block of candidates, and pairs that a task scores at once.
QUERY_ROWS, CANDIDATE_ROWS, SCORED_AT_ONCE = 16_384, 8_192, 1 << 22


def _vectors(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an Arrow column as rows of floats, and which of them are whole and finite."""
    rows = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    m = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1) if len(rows) else np.zeros((0, width))
    if m.shape[1] != width:
        raise ValueError(f"vectors of {m.shape[1]} components, planes of {width}")
    return m, np.isfinite(m).all(1)


def _distances(q: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """distance() of every row of q and every row of c; undefined ones are infinite."""
    if kind == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1 - q @ c.T / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1)))
    else:
        d = np.empty((len(q), len(c)))
        for i, own in enumerate(q):
            gap = own - c
            gap = np.abs(gap) if kind == "l1" else (gap - gap.mean(1, keepdims=True) if kind == "centred" else gap) ** 2
            d[i] = gap.sum(1)
        if kind not in ("l1", "squared", "centred"):
            d = np.sqrt(d)
    return np.where(np.isfinite(d), np.round(d, 9), np.inf)


def _candidates(asked: np.ndarray, stored: np.ndarray, bits: int, probe: bool) -> np.ndarray:
    """Which rows (codes `stored`, a column a table) each query meets in the buckets it looks into."""
    met = np.zeros((len(asked), len(stored)), bool)
    flips = [0, *[1 << i for i in range(bits)]] if probe else [0]
    for own, codes in zip(asked.T, stored.T, strict=True):
        order = np.argsort(codes, kind="stable")
        found, first = np.unique(codes[order], return_index=True)
        rows = dict(zip(found.tolist(), np.split(order, first[1:]), strict=True))
        for code in np.unique(own).tolist():
            bucket = [rows[code ^ f] for f in flips if code ^ f in rows]
            if bucket:
                met[np.ix_(np.flatnonzero(own == code), np.concatenate(bucket))] = True
    return met


def _best(query: np.ndarray, distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k least distances, ties by id."""
    order = np.lexsort((ids, distances, query))
    q = query[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return order[place < k]


def nearest(df: DataFrame, queries: DataFrame, tid: str, vector: str, planes: np.ndarray, k: int, kind: str = "cosine", probe: bool = False) -> DataFrame:
    """For each query the k nearest of its bucket candidates; probe looks into buckets one bit away too.

    Blocks of queries meet blocks of rows.  A task hashes both, looks the buckets of its rows up and scores what it
    finds there, so pairs are never written; only each query's k best of a block are.  Rows whose vector is
    null, or has a null or non-finite component, and pairs without a distance take no part.
    """
    from pyspark.sql import Window

    kinds = dict(df.dtypes)
    width, bits = planes.shape[-1], planes.shape[1]
    flat, weights = planes.reshape(-1, width), 1 << np.arange(bits, dtype=np.int64)
    coded = lambda m: ((m @ flat.T).reshape(len(m), *planes.shape[:2]) > 0) @ weights

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, stored: pa.Table) -> pa.Table:
        q, fine = _vectors(asked.column("vector"), width)
        c, whole = _vectors(stored.column("vector"), width)
        own, ids = _ids(asked.column("id")), _ids(stored.column("id"))
        q, own, c, ids = q[fine], own[fine], c[whole], ids[whole]
        at, near, who = np.zeros(0, np.int64), np.zeros(0), ids[:0]
        floor = np.full(len(q), np.inf)
        if len(q) and len(c):
            asked_codes, step = coded(q), max(1, SCORED_AT_ONCE // len(q))
            for i in range(0, len(c), step):
                part, names = c[i : i + step], ids[i : i + step]
                d = np.where(_candidates(asked_codes, coded(part), bits, probe) & (own[:, None] != names).astype(bool), _distances(q, part, kind), np.inf)
                last = min(k, d.shape[1]) - 1
                bound = np.minimum(floor, np.partition(d, last, axis=1)[:, last]) if last == k - 1 else floor
                x, y = np.nonzero((d <= bound[:, None]) & (d < np.inf))
                at, near, who = np.concatenate([at, x]), np.concatenate([near, d[x, y]]), np.concatenate([who, names[y]])
                keep = _best(at, near, who, k)
                at, near, who = at[keep], near[keep], who[keep]
                full, n = np.unique(at, return_counts=True)
                ends = np.cumsum(n) - 1
                floor[full[n == k]] = near[ends[n == k]]
        id_type = stored.schema.field("id").type
        return pa.table([pa.array(own[at], id_type), pa.array(who, id_type), pa.array(near, pa.float64())], names=["query_id", tid, "distance"])

    asked = queries.where(F.col(vector).isNotNull()).select(F.col(tid).alias("id"), F.col(vector).alias("vector"))
    stored = df.where(F.col(vector).isNotNull()).select(F.col(tid).alias("id"), F.col(vector).alias("vector"))
    across, down = (max(1, -(-t.count() // n)) for t, n in ((asked, QUERY_ROWS), (stored, CANDIDATE_ROWS)))
    down = max(down, 8)
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(29)), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = min(2 * across * down, 100_000)
    left = asked.select("id", "vector", deal(across).alias("across"), everywhere(down).alias("down")).repartition(cells, "across", "down").groupBy("across", "down")
    right = stored.select("id", "vector", everywhere(across).alias("across"), deal(down).alias("down")).repartition(cells, "across", "down").groupBy("across", "down")
    scored = left.cogroup(right).applyInArrow(run, f"query_id {kinds[tid]}, {tid} {kinds[tid]}, distance double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", tid))).where(F.col("rank") <= k)


def match_labels(pairs: DataFrame, vector: str = "similarities", seed: int = 1, scale: bool = False) -> DataFrame:
    """Adds match: a two-part Gaussian mixture over similarity vectors; the part with the larger mean matches."""
    data = pairs.withColumn("features", array_to_vector(vector))
    if scale:
        data = data.withColumnRenamed("features", "raw")
        data = MinMaxScaler(inputCol="raw", outputCol="features").fit(data).transform(data)
    model = GaussianMixture(k=2, seed=seed, featuresCol="features").fit(data)
    means = [float(np.mean(g.mean.toArray())) for g in model.gaussians]
    return model.transform(data).withColumn("match", F.col("prediction") == int(np.argmax(means))).withColumn("probability", vector_to_array("probability")).drop("features", "raw", "prediction")


def autoencoder_labels(pairs: DataFrame, vector: str = "similarities", hidden: int = 2, sample: int = 2000, seed: int = 1) -> DataFrame:
    """Adds match by a deep mixture: vectors are standardised and coded by a small autoencoder, and a two-part
    Gaussian mixture is fitted to the code beside its reconstruction error; the part whose vectors are larger on
    average matches.  The autoencoder is fitted on the driver from a bounded sample; all rows are coded."""
    from ..plans.models import Network

    data = pairs.where(F.col(vector).isNotNull())
    some = data.select(vector).orderBy(F.xxhash64(vector, F.lit(seed)), vector).limit(sample).collect()  # bounded
    x = np.array([r[0] for r in some], float)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
    width = x.shape[1] if len(x) else 1
    net = Network.random([width, 8, hidden, 8, width], seed=seed)
    if len(x):
        net.fit((x - mean) / scale, (x - mean) / scale, 300, 0.01)
    kinds = T.StructType([*data.schema.fields, T.StructField("features_", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(vector)).to_pylist()
            z = (np.array(own, float).reshape(len(own), width) - mean) / scale
            layers = net.run(z) if len(own) else [np.zeros((0, hidden))] * 5
            error = np.sqrt(((layers[-1] - z) ** 2).mean(1)) if len(own) else np.zeros(0)
            coded = np.column_stack([layers[2], error]).tolist()
            yield pa.record_batch([*batch.columns, pa.array(coded, pa.list_(pa.float64()))], names=[*batch.schema.names, "features_"])

    coded = data.mapInArrow(run, kinds).withColumn("features", array_to_vector("features_")).drop("features_")
    found = GaussianMixture(k=2, seed=seed, featuresCol="features").fit(coded).transform(coded)
    sizes = {r.prediction: r.size for r in found.groupBy("prediction").agg(F.avg(_sum(F.col(vector)) / F.size(vector)).alias("size")).collect()}  # two rows
    return found.withColumn("match", F.col("prediction") == max(sizes, key=sizes.get, default=0)).drop("features", "probability", "prediction")


def scored_pairs(pairs: DataFrame, scorer, a: str, b: str, threshold: float) -> DataFrame:
    """Pairs that a pluggable scorer (a function of two columns) puts above threshold."""
    return pairs.withColumn("score", scorer(F.col(a), F.col(b))).where(F.col("score") > threshold)


def entity_ids(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, eid: rows connected by labelled pairs share an id, the least of them."""
    return components(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))).select("node", F.col("component").alias("eid"))


def idf_keep(df: DataFrame, tid: str, tokens: Column, keep: int) -> DataFrame:
    """tid, summary: each row's `keep` tokens with the highest TF-IDF, in the order of the text."""
    from pyspark.sql import Window

    rows = df.select(tid, F.posexplode(tokens).alias("place", "token"))
    n = df.agg(F.count("*").alias("n"))  # one row
    idf = rows.groupBy("token").agg(F.countDistinct(tid).alias("df")).join(F.broadcast(n)).select("token", F.log(F.col("n") / F.col("df")).alias("idf"))
    tf = rows.groupBy(tid, "token").agg(F.count("*").alias("tf"), F.min("place").alias("place")).join(idf, "token")
    best = tf.withColumn("rank", F.row_number().over(Window.partitionBy(tid).orderBy(F.desc(F.col("tf") * F.col("idf")), "place"))).where(F.col("rank") <= keep)
    return best.groupBy(tid).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])).alias("summary"))


def augmented(c: Column, tid: Column, kind: str, seed: int = 1) -> Column:
    """A text of words changed in one place that a draw from the row and the seed names: drop (a word goes), swap (it
    changes places with the next), append (it is said again), trim (the words from there on go).  A text of one word
    stays as it is."""
    words = F.split(c, " ")
    n = F.size(words)
    at = (F.pmod(F.xxhash64(tid, F.lit(kind), F.lit(seed)), F.greatest(n - F.lit(int(kind == "swap")), F.lit(1))) + 1).cast("int")
    head, word, tail = F.slice(words, F.lit(1), at - 1), F.array(F.get(words, at - 1)), F.slice(words, at + 1, F.greatest(n, F.lit(1)))
    made = {
        "drop": lambda: F.concat(head, tail), "append": lambda: F.concat(head, word, word, tail), "trim": lambda: F.concat(head, word),
        "swap": lambda: F.concat(head, F.array(F.get(words, at)), word, F.slice(words, at + 2, F.greatest(n, F.lit(1)))),
    }[kind]()
    return F.when(n > 1, F.array_join(made, " ")).otherwise(c)


def inject_kinds(c: Column) -> Column:
    """Marks of numbers and codes in a text, so that a pair model sees them."""
    return F.regexp_replace(c, r"\b([0-9][0-9A-Za-z.-]*)\b", "[NUM] $1 [/NUM]")
