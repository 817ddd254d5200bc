"""Exact top-k search by columnar branch-and-bound (operator 5).

Query rows and candidate rows are dealt to the cells of a grid, so that neither side has to fit in one
place: a cell holds a bounded block of queries and a bounded block of candidates.  The cells of the first
block of candidates are searched first; the k-th best score that each query finds there goes with it into all
other cells as a bound that no result may fall below.  In a cell the
candidates lie in vertical layout, one array per dimension.  For each query the dimensions are taken
in blocks, heaviest first; a candidate's score so far plus (or minus) the product of both remaining
masses bounds its final score from above (below), so candidates whose upper bound is below the k-th
best lower bound are compacted away before the next block.  Cells return their k best; a window over
those few rows gives the answer.

Scores are exact integers: float64 holds every partial sum while the largest possible one is under
2**53, else Python integers are used (results saturate at the range of a long).

Defined cases: a vector that is null or has a null or non-finite component takes no part, nor has a
null id; vectors meet only vectors of their own length (an empty one scores 0 with another empty one);
a query is a vec_id, and rows with it are its own; if several rows have it, the k best are taken of the pairs
of each of them with every candidate; candidates with equal ids are separate rows; fewer than k
candidates are all returned; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpoint

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
DIMENSIONS = 8
SCALE = 256
LONG = (1 << 63) - 1

FOUND = "query_id long, query_row long, vec_id long, score long"
#: A bound that excludes nothing.
NONE = -LONG - 1


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column of equal lengths as floats, and which are whole and finite."""
    rows = [np.array([np.nan if x is None else x for x in v], np.float64) for v in column.to_pylist()]
    m = np.array(rows).reshape(len(rows), -1)
    with np.errstate(over="ignore", invalid="ignore"):
        m = np.floor(SCALE * m)
    return m, np.isfinite(m).all(1)


def _mass(m: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """Euclidean mass that remains after each block of dimensions (a little over, for rounding)."""
    own = np.stack([(m[:, b] ** 2).sum(1) for b in blocks], 1) if blocks else np.zeros((len(m), 0))
    left = np.concatenate([np.cumsum(own[:, ::-1], 1)[:, ::-1], np.zeros((len(m), 1))], 1)
    return np.sqrt(left) * (1 + 1e-12)


def best_of_cell(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray):
    """For each query the positions and scores of its k best rows that score `least` or more, branch-and-bound by
    dimensions."""
    n, d = rows.shape
    weight = np.abs(rows).mean(0) * np.abs(queries).mean(0) if n and len(queries) else np.zeros(d)
    order = np.argsort(-weight, kind="stable")
    blocks = [order[i : i + DIMENSIONS] for i in range(0, d, DIMENSIONS)]
    largest = (np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0)) * max(d, 1)
    if largest >= 2**53:  # too large for float64: plain integers
        whole = np.array([[int(x) for x in r] for r in rows], object).reshape(n, d)
        for q, own in zip(queries, query_ids, strict=True):
            score = [max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(q, r, strict=True)))) for r in whole]
            some = [i for i in range(n) if ids[i] != own]
            some.sort(key=lambda i: (-score[i], ids[i]))
            yield np.array(some[:k], np.int64), [score[i] for i in some[:k]]
        return
    vertical = np.ascontiguousarray(rows.T)
    row_mass, query_mass = _mass(rows, blocks), _mass(queries, blocks)
    for q, own, mass, known in zip(queries, query_ids, query_mass, least.astype(float), strict=True):
        alive = np.flatnonzero((ids != own) & (row_mass[:, 0] * mass[0] + 1e-6 >= known)) if blocks else np.flatnonzero(ids != own)
        so_far = np.zeros(len(alive))
        for j, b in enumerate(blocks):
            part = vertical[b] if len(alive) == n else vertical[np.ix_(b, alive)]
            so_far = so_far + q[b] @ part
            slack = row_mass[alive, j + 1] * mass[j + 1] + 1e-6
            floor = max(known, np.partition(so_far - slack, len(alive) - k)[len(alive) - k]) if len(alive) > k else known
            keep = so_far + slack >= floor
            if not keep.all():
                alive, so_far = alive[keep], so_far[keep]
        top = np.lexsort((ids[alive], -so_far))[:k]
        yield alive[top], so_far[top].astype(np.int64).tolist()


def _cell(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            q, ok = _matrix(queries.column("vector"))
            c, fine = _matrix(rows.column("vector"))
            q, c = q[ok], c[fine]
            ids = np.array(rows.column("vec_id").to_pylist(), np.int64)[fine]
            own = np.array(queries.column("vec_id").to_pylist(), np.int64)[ok]
            row = np.array(queries.column("row").to_pylist(), np.int64)[ok]
            least = np.array(queries.column("least").to_pylist(), np.int64)[ok]
            for i, (at, score) in enumerate(best_of_cell(q, own, c, ids, k, least)):
                out += [(int(own[i]), int(row[i]), int(v), int(s)) for v, s in zip(ids[at], score, strict=True)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """vectors (vec_id, embedding): the k best candidates of each row whose vec_id is divisible by every."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where("vec_id is not null and vector is not null")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, n_asked = base.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    across, down = max(1, math.ceil(n_asked / QUERY_BLOCK)), max(8, math.ceil(n / CANDIDATE_BLOCK))
    base = base.withColumn("size", F.size("vector"))
    deal = lambda column, m: F.pmod(F.xxhash64(column, F.lit(17)), F.lit(m)).cast("int")
    row = F.xxhash64("vec_id", "vector")  # rows of a query that are alike find the same
    queries = base.where(asked).groupBy("size", "vec_id", "vector").agg(F.count("*").alias("times")).withColumn("row", row).withColumn("across", deal("row", across))
    rows = base.select("size", "vec_id", "vector", deal("vec_id", down).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    cell = ("size", "across", "down")

    def search(asking: DataFrame, among: DataFrame, cells: int) -> DataFrame:
        """A task for each cell or so: adaptive execution would put them into a few by their bytes."""
        parts = min(cells, 100_000)
        asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # both sides stem from one table
        return asking.repartition(parts, *cell).groupBy(*cell).cogroup(among.repartition(parts, *cell).groupBy(*cell)).applyInArrow(_cell(k), FOUND)

    first = checkpoint(search(queries.withColumn("down", F.lit(0)).withColumn("least", F.lit(NONE)), rows.where("down = 0"), across))
    known = first.groupBy("query_id", "query_row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NONE)).alias("least"))
    bounded = queries.join(known, (F.col("vec_id") == F.col("query_id")) & (F.col("row") == F.col("query_row")), "left").select("size", "vec_id", "row", "vector", "across", F.coalesce("least", F.lit(NONE)).alias("least"))
    others = bounded.withColumn("down", F.explode(F.sequence(F.lit(1), F.lit(down - 1))))
    found = first.union(search(others, rows.where("down > 0"), across * (down - 1)))
    # at most k rows of a cell for each row of a query; a query's rows that are alike count each
    times = queries.where("times > 1").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "times")
    found = found.join(times, ["query_id", "query_row"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("times", F.lit(1)), F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
