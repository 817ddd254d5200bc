"""Column profiles, constants, and which columns may be compared."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counting import BIG, _present, histogram
from .shared import ranged

LONG_TEXT, NUMBER_TEXT = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def inferred_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, type: LONG if every present value is an integer literal, else NUMERIC, else STRING."""
    columns = columns or df.columns
    text = lambda c: F.trim(F.col(c).cast("string"))
    every = lambda c, p: F.min(F.when(F.coalesce(text(c), F.lit("")) == "", None).otherwise(text(c).rlike(p).cast("int")))
    row = df.agg(*[x for i, c in enumerate(columns) for x in (every(c, LONG_TEXT).alias(f"l{i}"), every(c, NUMBER_TEXT).alias(f"n{i}"))])
    kind = lambda i: F.when(F.col(f"l{i}") == 1, "LONG").when(F.col(f"n{i}") == 1, "NUMERIC").otherwise("STRING")
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(i).alias("type")) for i, c in enumerate(columns)])).alias("e")).select("e.*")


#: Declared type names; fixed values.
DECLARED = {"LONG": ("int", "tinyint", "smallint", "mediumint", "integer", "bigint", "int2", "int4", "int8", "serial2", "serial4", "serial8"), "NUMERIC": ("double", "float", "decimal", "float4", "float8")}


def declared(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their declared types; unknown type names are strings."""
    kind = lambda t: next((k for k, names in DECLARED.items() if t.lower().split("(")[0] in names), "STRING")
    spark = {"LONG": "bigint", "NUMERIC": "double", "STRING": "string"}
    return df.select(*[F.col(c).try_cast(spark[kind(types[c])]).alias(c) if c in types else F.col(c) for c in df.columns])


def useful_columns(df: DataFrame, skip: tuple[str, ...] = (), constants: bool = False) -> list[str]:
    """Columns that predicates may use; those whose name holds "id" give no constants."""
    return [c for c in df.columns if c not in skip and not (constants and "id" in c.lower())]


def prefix(df: DataFrame, ratio: float, *order: str) -> DataFrame:
    """The first ratio of the rows in an order, one at least.  Positions come from range partitions and their
    counts, never from one global window; only the rows of the partition that the cut falls into are ranked."""
    rows = ranged(df, *order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.sum("_n"))).alias("_keep"))  # one row
    marked = rows.join(F.broadcast(before.join(F.broadcast(total)).where("_before < _keep")), "_part")
    inside = marked.where("_before + _n <= _keep")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    edge = marked.where("_before + _n > _keep").withColumn("_place", place).where("_place <= _keep")
    return inside.select(*df.columns).union(edge.select(*df.columns))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct values, mean and population standard deviation (of numbers), minimum and maximum."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() not in ("string", "timestamp", "date", "boolean", "array")}
    number = lambda c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
    row = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.countDistinct(F.when(_present(df, [c]), F.col(c))).alias(f"d{i}"), F.round(F.avg(number(c)), 6).alias(f"m{i}"), F.round(F.stddev_pop(number(c)), 6).alias(f"s{i}"),
        F.min(number(c)).alias(f"a{i}"), F.max(number(c)).alias(f"b{i}"))])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("largest")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def few_values(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """Columns with at most `most` rows in all (the check that a column has next to no data)."""
    row = df.agg(*[F.count(F.when(_present(df, [c]), 1)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) <= most).alias("few")) for c in columns])).alias("e")).select("e.*")


def overlap(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Share of the multiset of a that b has too: sum of least over sum of greatest counts, over a's values."""
    f1 = histogram(left, a).select("value", F.col("n").alias("n1"))
    f2 = histogram(right, b).select("value", F.col("n").alias("n2"))
    both = f1.join(f2, "value", "left").select("n1", F.coalesce("n2", F.lit(0)).alias("n2"))
    return both.agg(F.round(F.sum(F.least("n1", "n2")) / F.sum(F.greatest("n1", "n2")), 9).alias("overlap"))


def shared_pairs(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Sum over common values of the product of their counts."""
    f1 = histogram(left, a).select("value", F.col("n").alias("n1"))
    return f1.join(histogram(right, b).select("value", F.col("n").alias("n2")), "value").agg(F.coalesce(F.sum(F.col("n1").cast(BIG) * F.col("n2")), F.lit(0)).cast(BIG).alias("pairs"))


def joinable(left: DataFrame, a: str, right: DataFrame, b: str, least: float = 0.3) -> DataFrame:
    """Whether two columns of different tables may be equated: same type, and enough of a's values in b."""
    same = left.schema[a].dataType == right.schema[b].dataType
    return overlap(left, a, right, b).select("overlap", (F.lit(same) & (F.col("overlap") > least)).alias("joinable"))


def comparable(left: DataFrame, a: str, right: DataFrame, b: str, least: float = 0.3) -> DataFrame:
    """Whether two numeric columns may be ordered: the ratios of means and of deviations exceed `least`."""
    s = left.agg(F.avg(a).alias("m1"), F.stddev_pop(a).alias("s1")).join(F.broadcast(right.agg(F.avg(b).alias("m2"), F.stddev_pop(b).alias("s2"))))  # one row each
    ratio = lambda x, y: F.round(F.when(F.greatest(F.abs(x), F.abs(y)) == 0, 1.0).otherwise(F.least(F.abs(x), F.abs(y)) / F.greatest(F.abs(x), F.abs(y))), 9)
    out = s.select(ratio(F.col("m1"), F.col("m2")).alias("mean_ratio"), ratio(F.col("s1"), F.col("s2")).alias("std_ratio"))
    return out.withColumn("comparable", (F.col("mean_ratio") > least) & (F.col("std_ratio") > least))


def column_pairs(tables: dict[str, DataFrame], least: float = 0.3, scored: Iterable[tuple[str, str, str, str]] = ()) -> DataFrame:
    """left, a, right, b, joinable, comparable: pairs of columns, of one table or two, that predicates may compare.

    A column goes with itself.  Columns of different tables are joinable if they have one type and enough of a's
    values are b's; numeric ones are comparable if means and deviations are alike; a pair with a scored predicate is
    joinable.  One pass for all profiles (means, deviations), one for all histograms: overlaps come from a join of
    the values of all columns of one type, so no pair of columns costs a job of its own.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = [(t, f.name, f.dataType) for t in sorted(tables) for f in tables[t].schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    numeric = {"integer", "long", "short", "byte", "float", "double", "decimal"}
    stats, values = [], []
    for t in sorted(tables):
        own = [(c, k) for x, c, k in columns if x == t]
        row = tables[t].agg(*[m for i, (c, k) in enumerate(own) if k.typeName() in numeric for m in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))] or [F.lit(0).alias("none")])
        entries = [F.struct(F.lit(t).alias("table"), F.lit(c).alias("name"), F.lit(k.simpleString()).alias("kind"), *([F.col(f"m{i}").cast("double").alias("mean"), F.col(f"s{i}").cast("double").alias("std")] if k.typeName() in numeric else [F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std")])) for i, (c, k) in enumerate(own)]
        stats.append(row.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
        entry = [F.struct(F.lit(c).alias("name"), F.lit(k.simpleString()).alias("kind"), F.when(_present(tables[t], [c]), F.col(c)).cast("string").alias("value")) for c, k in own]
        values.append(tables[t].select(F.explode(F.array(*entry)).alias("e")).select(F.lit(t).alias("table"), "e.*"))
    counts = reduce(DataFrame.unionByName, values).where("value is not null").groupBy("table", "name", "kind", "value").agg(F.count("*").alias("n"))
    x = counts.select(F.col("table").alias("left"), F.col("name").alias("a"), "kind", "value", "n")
    y = counts.select(F.col("table").alias("right"), F.col("name").alias("b"), "kind", "value", F.col("n").alias("m"))
    # the share is over a's values: common ones meet in the join, the others only count
    common = x.join(y, ["kind", "value"]).where(F.col("left") < F.col("right")).groupBy("left", "a", "right", "b").agg(F.sum(F.least("n", "m")).alias("both"), F.sum(F.greatest("n", "m") - F.col("n")).alias("more"))
    total = counts.groupBy(F.col("table").alias("left"), F.col("name").alias("a")).agg(F.sum("n").alias("total"))
    share = common.join(total, ["left", "a"]).select("left", "a", "right", "b", (F.col("both") / (F.col("total") + F.col("more"))).alias("overlap"))
    profile = reduce(DataFrame.unionByName, stats)  # a row a column
    p, q = (profile.select(*[F.col(c).alias(f"{c}{i}") for c in profile.columns]) for i in (0, 1))
    pairs = p.join(F.broadcast(q), (F.col("table0") < F.col("table1")) | (F.col("table0") == F.col("table1")) & (F.col("name0") <= F.col("name1")))
    ratio = lambda u, v: F.when(F.greatest(F.abs(u), F.abs(v)) == 0, 1.0).otherwise(F.least(F.abs(u), F.abs(v)) / F.greatest(F.abs(u), F.abs(v)))
    numbers = F.col("mean0").isNotNull() & F.col("mean1").isNotNull()  # least() and greatest() pass over nulls
    alike = numbers & (ratio(F.col("mean0"), F.col("mean1")) > least) & (ratio(F.col("std0"), F.col("std1")) > least)
    given = spark.createDataFrame([(*x, True) for x in scored], "left string, a string, right string, b string, given boolean")
    named = pairs.select(F.col("table0").alias("left"), F.col("name0").alias("a"), F.col("table1").alias("right"), F.col("name1").alias("b"), "kind0", "kind1", alike.alias("alike"))
    out = named.join(share, ["left", "a", "right", "b"], "left").join(F.broadcast(given), ["left", "a", "right", "b"], "left")
    itself = (F.col("left") == F.col("right")) & (F.col("a") == F.col("b"))
    joinable_ = itself | F.coalesce(F.col("given"), F.lit(False)) | (F.col("left") != F.col("right")) & (F.col("kind0") == F.col("kind1")) & F.coalesce(F.col("overlap") > least, F.lit(False))
    out = out.withColumn("joinable", joinable_).withColumn("comparable", F.coalesce("alike", F.lit(False)))
    return out.where("joinable or comparable").select("left", "a", "right", "b", "joinable", "comparable")


# ---------------------------------------------------------------- constants


def frequent_constants(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """column, value, n: present values whose share of all rows, in percent, lies strictly between low and
    high.  The columns' counts are one plan, a union of aggregates."""
    total = df.agg(F.count("*").alias("total"))  # one row
    parts = [histogram(df, c).select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "n") for c in columns]
    share = F.col("n") * 100 / F.col("total")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(total)).where((share > low) & (share < high)).drop("total")


def constants_above(df: DataFrame, column: str, least: int) -> DataFrame:
    return histogram(df, column).where(F.col("n") >= least)


def without_enumerations(constants: DataFrame, df: DataFrame, few: int) -> DataFrame:
    """Constants of columns with more than `few` distinct values."""
    columns = sorted(set(df.columns))
    many = column_stats(df, columns).where(F.col("n_distinct") > few).select("column")
    return constants.join(many, "column", "left_semi")


def valid_constants(constants: DataFrame) -> DataFrame:
    """Without blanks and values made of signs only."""
    return constants.where(F.trim("value").rlike(r"[\p{L}\p{N}]"))


def numeric_constants(df: DataFrame, column: str, k: int = 4, interval_percent: float = 1.0, seed: int = 1) -> DataFrame:
    """cluster, least, largest of a numeric column: KMeans on the scaled values, bounds in the column's own
    scale; bounds closer to the last kept one than interval_percent of the range go."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    vectors = VectorAssembler(inputCols=["v"], outputCol="raw").transform(values)
    scaled = MinMaxScaler(inputCol="raw", outputCol="features").fit(vectors).transform(vectors)
    model = KMeans(k=k, seed=seed, maxIter=20).fit(scaled)
    bounds = cluster_ranges(model.transform(scaled), "prediction", ["v"]).select(F.col("least_v").alias("least"), F.col("largest_v").alias("largest"))
    ends = bounds.select(F.col("least").alias("value")).union(bounds.select("largest")).distinct()  # 2 k rows
    span = ends.agg(((F.max("value") - F.min("value")) * interval_percent / 100).alias("step"))
    gap = F.col("value") - F.lag("value").over(Window.orderBy("value"))
    return ends.withColumn("gap", gap).join(F.broadcast(span)).where(F.col("gap").isNull() | (F.col("gap") >= F.col("step"))).select(F.lit(column).alias("column"), "value")


def cluster_ranges(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Least and largest value of each column in each cluster, and its rows."""
    measures = [m for c in columns for m in (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"largest_{c}"))]
    return df.groupBy(cluster).agg(*measures, F.count("*").alias("n"))


def null_patterns(df: DataFrame, columns: list[str], k: int = 2, seed: int = 1) -> DataFrame:
    """Rows clustered by which columns are missing: cluster, n, and the columns filled in half of it."""
    flags = df.select(*[(~_present(df, [c])).cast("double").alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(flags)
    found = KMeans(k=k, seed=seed).fit(vectors).transform(vectors).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    return found.select("cluster", "n", F.array_compact(F.array(*[F.when(F.col(c) < 0.5, F.lit(c)) for c in columns])).alias("filled"))


def sorted_dictionary(df: DataFrame, column: str) -> DataFrame:
    """value, code: codes in value order over the distinct values.  Codes come from range partitions, so
    no task sorts all values."""
    values = ranged(histogram(df, column).select("value"), "value")
    before = values.groupBy("_part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("value"))
    return values.join(F.broadcast(before.select("_part", "before")), "_part").select("value", (rank + F.col("before")).alias("code"))


def position_lists(df: DataFrame, column: str, tid: str) -> DataFrame:
    """value, tids and their number; only for values whose lists are wanted whole."""
    return df.where(_present(df, [column])).groupBy(F.col(column).alias("value")).agg(F.sort_array(F.collect_list(tid)).alias("tids"), F.count("*").alias("n"))


def evidence(df: DataFrame, tid: str, columns: list[str], block: str) -> DataFrame:
    """Ordered pairs of different rows that agree on column block, by which columns agree: mask, n.

    Every mask's count comes by inclusion and exclusion from group sizes, so no pairs are built: agree(S),
    the pairs that agree on S at least, is a sum of n (n - 1); exactly S is agree(S) less its supersets.
    """
    from itertools import combinations

    others = [c for c in columns if c != block]
    sets = [tuple(s) for r in range(len(others) + 1) for s in combinations(others, r)]
    # one pass: all sets of columns are grouping sets of the projected rows
    rows = df.where(_present(df, [block])).select(block, *[F.when(_present(df, [c]), F.col(c)).alias(c) for c in others])
    groups = rows.groupingSets([[F.col(c) for c in (block, *s)] for s in sets], *[F.col(c) for c in (block, *others)]).agg(F.count("*").cast(BIG).alias("_size"), F.grouping_id().alias("_gid"))
    whole = F.lit(True)
    mask = F.lit(0)
    for i, c in enumerate(others):
        out = F.col("_gid").bitwiseAND(1 << len(others) - 1 - i).cast("boolean")
        whole = whole & (F.col(c).isNotNull() | out)
        mask = mask + F.when(out, 0).otherwise(1 << i)
    at_least = groups.where(whole).groupBy(mask.alias("mask")).agg(F.sum(F.col("_size") * (F.col("_size") - 1)).cast(BIG).alias("agree"))
    upper = at_least.select(F.col("mask").alias("upper"), "agree")
    sign = F.when(F.bit_count(F.col("upper").bitwiseXOR(F.col("mask"))) % 2 == 0, 1).otherwise(-1)
    exact = at_least.select("mask").join(F.broadcast(upper), F.col("upper").bitwiseAND(F.col("mask")) == F.col("mask")).groupBy("mask").agg(F.sum(sign * F.col("agree")).cast("long").alias("n"))
    return exact.where("n > 0")
