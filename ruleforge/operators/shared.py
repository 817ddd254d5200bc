"""Folders that all executors share, lineage cut there, and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  A temporary one only where none is named and
    driver and executors are one process; a cluster without one is an error, not a guess."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in range partitions of an order, the number of each row's partition in `_part`, written once.

    Bounds come from a sample that every exchange draws anew, and two uses of a plan are two exchanges where they
    need other columns; so rows and what is counted of each partition must be read from one written copy.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a long, b long) as (node, component), component being the least node reachable.

    Alternating large-star and small-star steps: every step rewires links towards the least neighbour,
    by an aggregate and a join, so that no node's neighbours are ever gathered in one row.  Nodes
    without links are not listed.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = checkpoint(edges)
    seen = None
    for _ in range(rounds):
        # large star: each node's larger neighbours go to its least one (itself included)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = edges.join(least, edges.b == least.u).select(edges.a, F.col("m").alias("b"))
        # small star: each node and its smaller neighbours go to its least one
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(small, large.a == small.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(moved.union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
