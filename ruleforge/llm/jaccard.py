"""N-gram Jaccard join by size: heavy and light sets (operator 6).

A document's set holds its distinct shingles of ``width`` words.  Equal sets are one class from the
start.  Two classes link when ``100 * intersection >= percent * union``.

*Document frequencies.*  Every distinct shingle of a block asks the corpus how many documents have it
(see blocks.py).  A shingle of one document can be in no intersection, so it is never sent anywhere.

*Light sets* (up to a boundary): linked sets of sizes s and t share all shingles of some subset of c, c
at least percent/100 of each size; all such fixed-size subsets are enumerated and grouped.  In a group
every pair with ``100 * c >= percent * (s + t - c)`` links; linking each member to the smallest one
keeps all these connections, since a pair qualifies only if both qualify with the smallest.

*Heavy sets*: a pair that links shares one of the rarest ``s - ceil(s * percent / 100) + 1`` shingles of
each.  Classes connected by such shingles form candidate groups.  Within a group sets scan the inverted lists
of their shingles, which counts a set's exact overlap with all others at once.  Only which sets hang together
matters, so a group first gets a *core*: a set and all that link with it (and with further sets of the core).
Pairs inside of the core need no look; the sets outside scan the lists of all.  A group beyond ``SPREAD`` shingles
finds its core by rounds of one comparison for each set, spread over tasks, and then its outside and all its sets
are split into blocks of at most ``CELL``; pairs of blocks are separate tasks.  So a group of near copies that holds a third of all
sets costs a few passes over it and the scans of the sets outside of its core.  Only a spanning forest of the
links leaves a task, never all pairs.

The boundary is the one with the least estimated cost over the sizes that occur.  Sets between
boundary * percent/100 and the boundary take part on both sides, so no pair of a light and a heavy set
is lost.

Defined cases: null or empty text, or one without words, has an empty set, which links with nothing;
fewer than ``width`` words make one shingle; a null doc_id comes after every other, and is the component
of sets that only rows without id have; rows with equal doc_id are documents of their own, with one row
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .graph import checkpoint, components, written

WIDTH, PERCENT = 4, 85
#: The odd base of the shingles' fingerprints.
BASE = 0x5851F42D4C957F2D
#: Shingles in a task's block of a group, 8 MB of fingerprints, and of a group beyond which tasks share it.
CELL, SPREAD = 1_000_000, 1_000_000
#: Sizes among which the boundary is sought, and the cost of a heavy shingle against a light subset.
LARGEST_LIGHT, HEAVY_COST = 24, 8
#: Up to so many pairs of numbers (some 40 MB) are broadcast to find documents; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

SETS = "doc_id long, row long, key long, n_shingles long, set_a long, set_b long, prefix int, live binary"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (document, fingerprint), sorted."""
    start, _, doc, (word,) = B.coded_words(raw, offsets, (9,), _LOWER)
    del start
    at, key = B.window_keys(word, doc, width, BASE)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < width))  # the whole sequence is one shingle
    if len(short):
        first = np.searchsorted(doc, short)
        own = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            has = count[short] > i
            own[has] = own[has] * np.uint64(BASE) + word[first[has] + i]
        key = np.concatenate([key, B.mix(own + B.mix(count[short].astype(np.uint64)))])
    d = np.concatenate([doc[at], short])
    by = np.lexsort((key, d))
    by = by[B.first_of_runs(d[by], key[by])]
    return d[by], key[by]


def _block_sets(table: pa.Table, width: int):
    B.trim()
    return shingle_sets(*B.flat(table.column("text")), width)


#: Frequencies are asked for by the first 48 bits: two shingles that agree there count as one, which
#: makes a shingle look more frequent than it is and changes no link.
_COARSE = np.uint64(0xFFFFFFFFFFFF0000)


def _coarse_counts(keys: np.ndarray):
    values, entry, counts = np.unique(keys & _COARSE, return_inverse=True, return_counts=True)
    return values, entry, counts.astype(np.uint32)


def _frequency(keys, row, columns):
    """0: one document has it; else a class that grows with the number of documents."""
    (count,) = columns
    by = np.argsort(keys, kind="stable")
    new = B.first_of_runs(keys[by])
    run = np.cumsum(new) - 1
    total = np.bincount(run, weights=count[by]) if len(by) else np.zeros(0)
    kind = np.where(total < 2, 0, np.minimum(255, np.round(4 * np.log2(np.maximum(total, 2))))).astype(np.uint8)
    out = np.zeros(len(keys), np.uint8)
    out[by] = kind[run]
    return out


def ceil_share(size, percent: int):
    """The least integer of at least percent/100 of size."""
    return (size * percent + 99) // 100


def _set_rows(width: int, percent: int):
    def run(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        doc, shingle = _block_sets(table, width)
        _, entry, _ = _coarse_counts(shingle)
        kind = B.answers(said, 1)[entry] if len(shingle) else np.zeros(0, np.uint8)
        m = table.num_rows
        size = np.bincount(doc, minlength=m)
        sums = lambda v: np.bincount(doc, weights=v, minlength=m)
        # two fingerprints of the whole set, as wrapping sums of mixed shingles
        total = [np.zeros(m, np.uint64), np.zeros(m, np.uint64)]
        at = np.searchsorted(doc, np.arange(m))
        for j in range(2):
            v = np.concatenate([B.mix(shingle + np.uint64(j + 1)), [np.uint64(0)]])
            part = np.add.reduceat(v, at) if m else np.zeros(0, np.uint64)
            total[j] = np.where(size > 0, part, np.uint64(0)) ^ B.mix(size.astype(np.uint64))
        by = np.lexsort((shingle, kind, doc))
        rank = np.arange(len(by)) - at[doc[by]]
        keep = size - ceil_share(size, percent) + 1
        in_prefix = (rank < keep[doc[by]]) & (kind[by] > 0)
        prefix = np.bincount(doc[by][in_prefix], minlength=m)
        n_live = sums(kind > 0).astype(np.int64)
        shingle, kind = shingle[by], kind[by]
        live = [shingle[e - n : e].astype("<u8").tobytes() if p else None for e, n, p in zip((at + size).tolist(), n_live.tolist(), prefix.tolist(), strict=True)]
        order = B.order_of(table.column("doc_id"))
        columns = [table.column("doc_id"), table.column("row"), pa.array(order), pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in total), pa.array(prefix, pa.int32()), pa.array(live, pa.binary())]
        return pa.table(columns, names=["doc_id", "row", "key", "n_shingles", "set_a", "set_b", "prefix", "live"])

    return run


def document_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per document: its set's size and fingerprints, its live shingles (those that other documents
    have too, rarest first) unless none is in the prefix, and how many of them are."""
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    size = B.text_bytes(source)
    n, buckets = B.n_blocks(size), B.n_buckets(size)
    by_block = B.blocked(source, n).groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        values, _, counts = _coarse_counts(_block_sets(table, width)[1])
        return B.entry_rows(table.column("block")[0].as_py(), 1, buckets, values, counts)

    said = by_block.applyInArrow(ask, B.EXCHANGE_SCHEMA).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(B.resolver((np.uint32,), _frequency, 1), B.ANSWER_SCHEMA)
    return by_block.cogroup(said.repartition(n, "block").groupBy("block")).applyInArrow(_set_rows(width, percent), SETS)


# ---------------------------------------------------------------- light sets


def n_subsets(size: int, percent: int) -> int:
    return sum(math.comb(size, c) for c in range(ceil_share(size, percent), size + 1))


def boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest size of light sets with the least estimated cost; sizes: how many classes have each."""
    light = heavy = 0.0
    heavy = sum(n * s * HEAVY_COST for s, n in sizes.items() if s <= LARGEST_LIGHT)
    best, cost = 0, heavy
    for b in range(1, LARGEST_LIGHT + 1):
        light += sizes.get(b, 0) * n_subsets(b, percent)
        heavy -= sizes.get(b, 0) * b * HEAVY_COST
        if light + heavy <= cost:
            best, cost = b, light + heavy
    return best


def _subsets(percent: int):
    def run(batches):
        for batch in batches:
            key, n, c, subset = [], [], [], []
            for k, size, live in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = B.mix(np.frombuffer(live, "<u8") + np.uint64(3)).tolist()
                for k_of in range(ceil_share(size, percent), len(own) + 1):
                    for left_out in itertools.combinations(own, len(own) - k_of):
                        key.append(k)
                        n.append(size)
                        c.append(k_of)
                        subset.append((sum(own) - sum(left_out)) & 0x7FFFFFFFFFFFFFFF)
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(subset, pa.int64())], names=["key", "size", "c", "subset"])

    return run


def light_links(classes: DataFrame, limit: int, percent: int) -> DataFrame:
    rows = classes.where(F.col("n_shingles") <= limit).select("key", "n_shingles", "live").mapInArrow(_subsets(percent), "key long, size long, c long, subset long")
    least = rows.groupBy("c", "subset").agg(F.min(F.struct("size", "key")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    pair = rows.join(least, ["c", "subset"]).where((F.col("key") != F.col("least.key")) & (100 * F.col("c") >= percent * (F.col("size") + F.col("least.size") - F.col("c"))))
    return pair.select(F.col("key").alias("a"), F.col("least.key").alias("b"))


# ---------------------------------------------------------------- heavy sets


def _tokens(batches):
    for batch in batches:
        keys, tokens = [], []
        for k, prefix, live in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            keys.append(np.full(prefix, k, np.int64))
            tokens.append(np.frombuffer(live, "<i8", prefix))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(cat(keys)), pa.array(cat(tokens))], names=["key", "token"])


def cell_links(left, right, percent: int, core: frozenset = frozenset()) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of (key, size, shingles), or within one (right None): sets
    scan the inverted lists of their shingles.  core: keys that hang together already.

    Within one list, sets that hang together with the first one need no scan of their own once the others had
    theirs: of two sets without a scan both do so.
    """
    rows = left if right is None else right
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    token = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    sizes = np.array([r[1] for r in rows], np.int64)
    # every key has one root; a second side of the same keys joins the same forest
    parent = {r[0]: r[0] for r in itertools.chain(left, right or ())}
    inside = [k for k in parent if k in core]
    parent.update(dict.fromkeys(inside, min(inside, default=0)))

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []

    def scan(key, size, own):
        low, high = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
        n = high - low
        end = np.cumsum(n)
        hit = owner[np.repeat(low - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        overlap = np.bincount(hit, minlength=len(rows))
        for j in np.flatnonzero((100 * overlap >= percent * (size + sizes - overlap)) & (overlap > 0)).tolist():
            a, b = root(key), root(rows[j][0])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((key, rows[j][0]))

    if right is not None:
        for r in left:
            scan(*r)
        return out
    for r in left[:1]:
        scan(*r)
    # a few more of the first one's links widen what needs no scan
    for r in [r for r in left[1:] if root(r[0]) == root(left[0][0])][:: max(1, len(left) // 4)]:
        scan(*r)
    for r in left[1:]:
        if root(r[0]) != root(left[0][0]):
            scan(*r)
    return out


def _cells(percent: int):
    def run(table: pa.Table) -> pa.Table:
        B.trim()
        rows: dict[tuple, dict[bool, list]] = {}
        core: dict[tuple, set] = {}
        for group, i, j, outside, in_core, key, size, live in zip(*(table.column(c).to_pylist() for c in ("group", "i", "j", "outside", "in_core", "key", "n_shingles", "live")), strict=True):
            rows.setdefault((group, i, j), {}).setdefault(outside, []).append((key, size, np.frombuffer(live, "<i8")))
            if in_core:
                core.setdefault((group, i, j), set()).add(key)
        found = []
        for cell, sides in rows.items():
            if cell[1] < 0:  # a whole group
                found += cell_links(sides[False], None, percent)
            elif True in sides and False in sides:
                found += cell_links(sides[True], sides[False], percent, frozenset(core.get(cell, ())))
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _near_pivot(percent: int):
    """Of rows with their group's pivot: component, key, pivot where the two sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, own, m, pivot in zip(*(batch.column(i).to_pylist() for i in (2, 3, 5, 6)), strict=True):
                both = len(np.intersect1d(np.frombuffer(own, "<i8"), np.frombuffer(pivot, "<i8"), assume_unique=True))
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1), batch.column(4))], names=["component", "key", "pivot"])

    return run


#: Rounds that widen the core of a large group, and parts that its comparisons are dealt to.
ROUNDS, SALTS = 3, 64


def cores(large: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """component, key, pivot: the cores of large groups, each key with the set it links with.  A round compares
    every set outside of the core with one pivot of its group; the first pivot is any set, later ones are sets of
    the core.  A group's sets are dealt to SALTS tasks, to each of which its pivot goes."""
    salt = F.pmod(F.xxhash64("key", F.lit(23)), F.lit(SALTS)).cast("int")
    large = large.withColumn("salt", salt)
    core = None
    for r in range(rounds):
        among = large if core is None else large.join(core.select("component", "key"), ["component", "key"], "left_semi")
        chosen = among.groupBy("component").agg(F.min(F.struct(F.xxhash64("key", F.lit(r)), "key")).alias("least")).select("component", F.col("least.key").alias("key"))
        pivots = among.join(chosen, ["component", "key"]).select("component", F.col("key").alias("pivot"), F.col("n_shingles").alias("pivot_size"), F.col("live").alias("pivot_live"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        outside = large if core is None else large.join(core.select("component", "key"), ["component", "key"], "left_anti")
        met = outside.join(pivots, ["component", "salt"]).select("component", "key", "n_shingles", "live", "pivot", "pivot_size", "pivot_live")
        new = met.mapInArrow(_near_pivot(percent), "component long, key long, pivot long")
        core = checkpoint(new if core is None else core.union(new))
    return core


def heavy_links(classes: DataFrame, least_size: int, percent: int, cell: int = CELL, spread: int = SPREAD) -> DataFrame:
    rows = classes.where(F.col("n_shingles") >= least_size)
    tokens = rows.select("key", "prefix", "live").mapInArrow(_tokens, "key long, token long")
    centre = tokens.groupBy("token").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = tokens.join(centre, "token").select(F.col("key").alias("a"), "b").where("a <> b").distinct()
    group = components(near)
    sized = rows.join(group, rows.key == group.node).select("component", "key", "n_shingles", "live")
    weight = checkpoint(sized.groupBy("component").agg(F.sum(F.octet_length("live") / 8).alias("weight")))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells, schema = _cells(percent), "a long, b long"
    small = sized.join(weight.where(F.col("weight") <= spread), "component").select(F.col("component").alias("group"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("outside"), F.lit(False).alias("in_core"), "key", "n_shingles", "live")
    links = small.withColumn("task", F.pmod(F.xxhash64("group"), F.lit(8 * parts))).groupBy("task").applyInArrow(cells, schema)
    split = weight.where(F.col("weight") > spread)
    if split.isEmpty():
        return links
    large = checkpoint(sized.join(split, "component"))
    core = cores(large.drop("weight"), percent)
    marked = large.join(core.select("component", "key", F.lit(True).alias("inside")), ["component", "key"], "left").withColumn("in_core", F.coalesce("inside", F.lit(False))).drop("inside")
    outside_weight = marked.where(~F.col("in_core")).groupBy("component").agg(F.sum(F.octet_length("live") / 8).alias("outside_weight"))
    dealt = marked.join(outside_weight, "component").withColumn("down", F.ceil(F.col("outside_weight") / cell).cast("int")).withColumn("across", F.ceil(F.col("weight") / F.least(F.greatest("outside_weight", F.lit(spread)), F.lit(cell))).cast("int"))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ("group", "i", "j", "outside", "in_core", "key", "n_shingles", "live")
    one = dealt.where(~F.col("in_core")).select(F.col("component").alias("group"), place("down").alias("i"), every("across").alias("j"), F.lit(True).alias("outside"), "in_core", "key", "n_shingles", "live")
    other = dealt.select(F.col("component").alias("group"), every("down").alias("i"), place("across").alias("j"), F.lit(False).alias("outside"), "in_core", "key", "n_shingles", "live")
    both = one.select(*names).unionByName(other.select(*names)).withColumn("task", F.xxhash64("group", "i", "j"))
    within = core.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    return links.union(within).union(both.groupBy("task").applyInArrow(cells, schema))


# ---------------------------------------------------------------- the operator


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: doc_id, row (a hash of the text), key (its order), n_shingles, the group of linked
    documents (null where none can be) and the least key in it."""
    sets = written(document_sets(docs, width, percent))
    classes = sets.where("prefix > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("key").alias("least"), F.first("prefix").alias("prefix"), F.first("live").alias("live"))
    # a class's own number: rows without id share the last key, so keys alone would not tell them apart
    classes = written(classes.withColumn("key", F.xxhash64("n_shingles", "set_a", "set_b")))
    sizes = {int(r[0]): int(r[1]) for r in classes.where(F.col("n_shingles") <= LARGEST_LIGHT).groupBy("n_shingles").count().collect()}
    limit = boundary(sizes, percent)
    links = light_links(classes, limit, percent).union(heavy_links(classes, ceil_share(limit + 1, percent), percent))
    group = components(links)
    least = group.join(classes.select("key", "least"), group.node == F.col("key")).groupBy("component").agg(F.min("least").alias("reach"))
    reach = group.join(least, "component").select("node", "component", "reach")
    own = classes.select("key", "n_shingles", "set_a", "set_b", "least").join(reach, F.col("key") == F.col("node"), "left")
    own = own.select("n_shingles", "set_a", "set_b", F.coalesce("component", "key").alias("group"), F.coalesce("reach", "least").alias("reach"))
    out = sets.select("doc_id", "row", "key", "n_shingles", "set_a", "set_b").join(own, ["n_shingles", "set_a", "set_b"], "left")
    return out.select("doc_id", "row", "key", "n_shingles", "group", F.coalesce("reach", "key").alias("reach"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) per document."""
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", F.when(F.col("reach") != B.LAST, F.col("reach")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of linked ones: that with the least doc_id, among equal ids
    that with the least hash of its text; of rows alike in both, one.  Documents with empty sets all stay."""
    grouped = written(_grouped(docs, width, percent).where("group is not null").select("doc_id", "row", "key", "group"))
    best = grouped.groupBy("group").agg(F.min(F.struct("key", "row")).alias("best"))
    lost = grouped.join(best, "group").where((F.col("key") != F.col("best.key")) | (F.col("row") != F.col("best.row"))).select(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row")).distinct()
    row = F.xxhash64(docs["text"].cast("string"))
    doc_id = docs["doc_id"].cast("long")
    lost = checkpoint(lost)
    if lost.count() <= BROADCAST_ROWS:  # spares the texts a shuffle
        lost = F.broadcast(lost)
    left = docs.join(lost, doc_id.eqNullSafe(lost.lost_id) & (row == lost.lost_row), "left_anti")
    # a group's best may stand in several rows that are alike; that is rare, so it is looked for first
    twice = grouped.join(best, "group").where((F.col("key") == F.col("best.key")) & (F.col("row") == F.col("best.row"))).groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("twice_id"), F.col("row").alias("twice_row"))
    if twice.isEmpty():
        return left
    alike = doc_id.eqNullSafe(twice.twice_id) & (row == twice.twice_row)
    return left.join(twice, alike, "left_anti").unionByName(left.join(twice, alike, "left_semi").dropDuplicates(["doc_id", "text"]))
