"""Samples of rows.  All draws come from hashes of the row and a seed, so a repeated run, or a task that
is run again, draws the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counting import _present
from .shared import checkpoint


def draw(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from a row and a seed."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


#: Cells of the histogram that finds a cut, and rows of a value that are numbered together.
CELLS, SALTS = 1 << 14, 32


def uniform(df: DataFrame, ratio: float, tid: str, seed: int = 1, by: Column | None = None) -> DataFrame:
    """Exactly floor(ratio * n) rows without replacement: those with the least draws (by, if given).

    The cut is found from a histogram of the draws, so no task sorts all rows; only the rows in the
    histogram's last cell are ranked.
    """
    rows = df.withColumn("_draw", draw(seed, tid) if by is None else by).withColumn("_cell", F.floor(F.col("_draw") * CELLS).cast("int"))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("n"))  # at most CELLS rows
    upto = F.sum("n").over(Window.orderBy("_cell"))
    want = df.agg(F.floor(F.lit(ratio) * F.count("*")).alias("want"))
    cut = counts.withColumn("upto", upto).join(F.broadcast(want)).where(F.col("upto") >= F.col("want")).agg(F.min(F.struct("_cell", (F.col("want") - F.col("upto") + F.col("n")).alias("left"))).alias("cut"))
    marked = rows.join(F.broadcast(cut))
    inside = marked.where(F.col("_cell") < F.col("cut._cell"))
    last = marked.where(F.col("_cell") == F.col("cut._cell")).withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", tid))).where(F.col("_rank") <= F.col("cut.left"))
    return inside.select(*df.columns).union(last.select(*df.columns))


def with_replacement(df: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    return df.sample(True, ratio, seed)


def random_walks(df: DataFrame, tid: str, columns: list[str], ratio: float, steps: int = 1, seed: int = 1) -> DataFrame:
    """Walks over tuples that share values: a start tuple, then `steps` times an attribute, chosen with a
    weight of how many tuples share the value, and a tuple of the same value.

    All walks take a step together.  A partner is the row whose number within the value's group is drawn.
    Results are the distinct tuples visited.
    """
    at = uniform(df, ratio, tid, seed).select(tid)
    places, visited = _numbered(df, tid, columns, seed), at
    for step in range(steps):
        at = _walk(at, places, tid, seed + 31 * step)
        visited = visited.union(at)
    return df.join(visited.distinct(), tid, "left_semi")


def walk_sample(df: DataFrame, tid: str, columns: list[str], ratio: float, rounds: int = 64, seed: int = 1) -> DataFrame:
    """floor(ratio * n) tuples (one at least) that random walks visit: walks start at half of them and go on, step by
    step; where walks meet or end, others start, again at half of what is missing.  Of the last step's tuples those
    with the least draws are kept."""
    total = df.count()
    want = max(1, int(ratio * total))
    places = checkpoint(_numbered(df, tid, columns, seed))
    start = lambda rows, n, share, s: checkpoint(uniform(rows.select(tid), max(0.0, (n * share + 1) / max(total, 1)), tid, s))
    visited = at = start(df, want, 0.5, seed)
    n = at.count()
    for step in range(rounds):
        if n >= want:
            break
        new = checkpoint(_walk(at, places, tid, seed + 31 * step).join(visited, tid, "left_anti"))
        found = new.count()
        if found < (want - n) / 4:
            rest = df.select(tid).join(visited, tid, "left_anti").join(new, tid, "left_anti")
            more = (want - n - found) * 0.5 + 1
            new = checkpoint(new.union(uniform(rest, min(1.0, more / max(total - n - found, 1)), tid, seed + step + 1)))
            found = new.count()
        if n + found > want:
            new, found = checkpoint(uniform(new, (want - n + 0.5) / found, tid, seed)), want - n
        visited, at, n = checkpoint(visited.union(new)), new, n + found
    if n > want:
        visited = uniform(visited, (want + 0.5) / n, tid, seed)
    return df.join(visited, tid, "left_semi")


def _numbered(df: DataFrame, tid: str, columns: list[str], seed: int) -> DataFrame:
    """tid, attribute, value, number, size: every row's place among the rows of equal value, in an order of draws.
    The rows of one value are numbered in SALTS parts, which the sizes of the parts before them put together, so a
    value that a third of all rows have is no single task's."""
    entry = [F.struct(F.lit(c).alias("attribute"), F.when(_present(df, [c]), F.col(c)).cast("string").alias("value")) for c in columns]
    rows = df.select(tid, F.explode(F.array(*entry)).alias("e")).select(tid, "e.attribute", "e.value").where("value is not null")
    rows = rows.withColumn("salt", F.floor(draw(seed, tid) * SALTS).cast("int"))
    sizes = rows.groupBy("attribute", "value", "salt").agg(F.count("*").alias("_n"))
    of_value = Window.partitionBy("attribute", "value")
    before = F.coalesce(F.sum("_n").over(of_value.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("attribute", "value", "salt", before.alias("before"), F.sum("_n").over(of_value).alias("size"))
    within = F.row_number().over(Window.partitionBy("attribute", "value", "salt").orderBy(draw(seed, tid), tid))
    return rows.withColumn("within", within).join(offsets, ["attribute", "value", "salt"]).select(tid, "attribute", "value", (F.col("before") + F.col("within")).alias("number"), "size")


def _walk(at: DataFrame, places: DataFrame, tid: str, seed: int) -> DataFrame:
    """One step of all walks: an attribute, chosen with a weight of how many tuples share the value, and another
    tuple of that value."""
    mine = at.withColumnRenamed(tid, "_at").join(places.withColumnRenamed(tid, "_at"), "_at").where("size > 1")
    # a weighted choice: the greatest u ** (1 / weight)
    key = F.log(draw(seed + 7, "_at", "attribute") + F.lit(1e-12)) / F.col("size")
    chosen = mine.withColumn("_k", key).groupBy("_at").agg(F.max(F.struct("_k", "attribute", "value", "number", "size")).alias("c")).select("_at", "c.attribute", "c.value", "c.number", "c.size")
    other = F.floor(draw(seed + 13, "_at", "value") * (F.col("size") - 1)) + 1
    target = chosen.select("attribute", "value", (other + F.when(other >= F.col("number"), 1).otherwise(0)).alias("number"))
    return target.join(places, ["attribute", "value", "number"]).select(tid).distinct()


def cluster_ranked(df: DataFrame, tid: str, vector: str, cluster: str, ratio: float) -> DataFrame:
    """In each cluster the share of tuples with the greatest sum of cosine distances to the others.

    The sum over the others is linear in the sum of unit vectors, so it needs that one vector per cluster
    and no pairs: n - u . sum(u).
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = df.select("*", F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm)).alias("_unit"))
    flat = unit.select(cluster, F.posexplode("_unit").alias("_i", "_x")).groupBy(cluster, "_i").agg(F.sum("_x").alias("_s"))
    total = flat.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda p: p["_s"]).alias("_total"))  # as long as a vector
    size = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    dot = F.aggregate(F.zip_with("_unit", "_total", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    ranked = unit.join(total, cluster).join(size, cluster).withColumn("_distance", F.round(F.col("_n") - dot, 9))
    # the cut of each cluster comes from a histogram of its distances; only the cell it falls into is ranked
    low, high = F.min("_distance").alias("_low"), F.max("_distance").alias("_high")
    ranked = ranked.join(ranked.groupBy(cluster).agg(low, high), cluster)
    cell = F.coalesce(F.floor(F.try_divide(F.col("_high") - F.col("_distance"), F.col("_high") - F.col("_low")) * 4096), F.lit(0))
    ranked = ranked.withColumn("_cell", cell).withColumn("_keep", F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)))
    upto = F.sum("_m").over(Window.partitionBy(cluster).orderBy("_cell"))
    cells = ranked.groupBy(cluster, "_cell", "_keep").agg(F.count("*").alias("_m")).withColumn("_upto", upto)  # at most 4,097 of a cluster
    cut = cells.where("_upto >= _keep").groupBy(cluster).agg(F.min(F.struct("_cell", (F.col("_keep") - F.col("_upto") + F.col("_m")).alias("left"))).alias("_cut"))
    marked = ranked.join(cut, cluster)
    inside = marked.where(F.col("_cell") < F.col("_cut._cell"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("_distance"), tid))
    edge = marked.where(F.col("_cell") == F.col("_cut._cell")).withColumn("_place", place).where(F.col("_place") <= F.col("_cut.left"))
    return inside.select(*df.columns).union(edge.select(*df.columns))


def rounds(df: DataFrame, ratio: float, tid: str, n: int, run) -> DataFrame:
    """run(sample, round) on n samples with seeds 1 to n; the distinct rows of all results."""
    return reduce(DataFrame.unionByName, [run(uniform(df, ratio, tid, seed), seed) for seed in range(1, n + 1)]).distinct()


def random_pairs(df: DataFrame, tid: str, n: int, seed: int = 1) -> DataFrame:
    """n distinct pairs of different ids (as far as there are as many neighbours in random order)."""
    parts = []
    need, i = n, 0
    count = df.count()
    while need > 0 and count > 1 and i < 64:
        ring = Window.partitionBy(F.lit(0)).orderBy(draw(seed + i, tid), tid)  # ids of rules: a few thousand
        parts.append(df.select(F.col(tid).alias("x"), F.lead(tid).over(ring).alias("y")).where("y is not null"))
        need -= count - 1
        i += 1
    pairs = reduce(DataFrame.unionByName, parts).select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()
    return pairs.orderBy(F.xxhash64("left_id", "right_id", F.lit(seed)), "left_id", "right_id").limit(n)
