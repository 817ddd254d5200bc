"""Joins over tuple variables, foreign keys and blocks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counting import histogram
from .predicates import Predicate, holds, present


def _text(*tables: DataFrame) -> set[str]:
    return {f.name for t in tables for f in t.schema if f.dataType.typeName() == "string"}


def tuple_pairs(left: DataFrame, right: DataFrame, predicates: Iterable[Predicate], tid0: str, tid1: str, same: bool = False, scored: dict[str, DataFrame] | None = None) -> DataFrame:
    """(tid0, tid1) of the pairs that satisfy all predicates; all equalities together are one hash key.
    scored maps a predicate's text to its pairs (tid0, tid1), which semi-join the result."""
    text = _text(left, right)
    plain = [p for p in predicates if not p.is_scored]
    join = reduce(lambda a, b: a & b, [holds_for_join(p, text) for p in plain if p.right], F.lit(True))
    rows = left.alias("t0").join(right.alias("t1"), join)
    for p in plain:
        if p.is_constant:
            rows = rows.where(holds(p, text))
    if same:
        rows = rows.where(F.col(f"t0.{tid0}") != F.col(f"t1.{tid1}"))
    out = rows.select(F.col(f"t0.{tid0}").alias("tid0"), F.col(f"t1.{tid1}").alias("tid1"))
    for p in predicates:
        if p.is_scored:
            out = out.join((scored or {})[str(p)].select("tid0", "tid1"), ["tid0", "tid1"], "left_semi")
    return out


def holds_for_join(p: Predicate, text: set[str]):
    """Plain comparison plus presence as separate conjuncts, so that equalities stay join keys."""
    a, b = F.col(f"t{p.left.variable}.{p.left.column}"), F.col(f"t{p.right.variable}.{p.right.column}")
    from .predicates import compare

    out = compare(a, p.op, b)
    if p.left.column in text:
        out = out & present(a)
    return out & present(b) if p.right.column in text else out


def chain(tables: list[DataFrame], tids: list[str], predicates: Iterable[Predicate], select: tuple[int, int] = (0, 1)) -> DataFrame:
    """Pairs of the two selected variables for which rows of all others exist.

    A variable that nothing else needs any more is checked by a semi join; only those on a path between
    the selected ones are joined.  Edges go from the selected pair outward.  Rows of one table on
    different variables are different rows.
    """
    text, edges = _text(*tables), [p for p in predicates if p.right]
    a, b = select
    named = [t.select(*[F.col(c).alias(f"v{i}_{c}") for c in t.columns]) for i, t in enumerate(tables)]
    for p in predicates:
        if p.is_constant:
            v = p.left.variable
            named[v] = named[v].where(F.col(f"v{v}_{p.left.column}") == p.constant)
    col = lambda o: F.col(f"v{o.variable}_{o.column}")
    on = lambda p: (col(p.left) == col(p.right)) & present(col(p.left), p.left.column in text)
    differ = lambda seen, v: reduce(lambda x, y: x & y, [F.col(f"v{u}_{tids[u]}") != F.col(f"v{v}_{tids[v]}") for u in seen if tables[u] is tables[v]], F.lit(True))
    seen = [a]
    rows = named[a]
    later = [b, *[v for v in range(len(tables)) if v not in select]]
    while later:
        v = next(v for v in later if any(p.variables <= {*seen, v} and v in p.variables for p in edges))
        conditions = reduce(lambda x, y: x & y, [on(p) for p in edges if v in p.variables and p.variables <= {*seen, v}]) & differ(seen, v)
        needed = v == b or any(v in p.variables and not p.variables <= {*seen, v} for p in edges)
        rows = rows.join(named[v], conditions, "inner" if needed else "left_semi")
        if needed:
            seen.append(v)
        later.remove(v)
    return rows.select(F.col(f"v{a}_{tids[a]}").alias("tid0"), F.col(f"v{b}_{tids[b]}").alias("tid1")).distinct()


#: Pairs of a group that one task makes.
PAIRS_OF_A_TASK = 1 << 20


def dealt(rows: DataFrame, partners: DataFrame, key: str, tid: str, size: str) -> DataFrame:
    """rows joined with the partners of their group; partners (key and others) are repeated for each part of a
    group's rows, so that a task makes a bounded number of pairs.  size: a partner row's weight in pairs."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_rows")).join(partners.groupBy(key).agg(F.sum(size).alias("_partners")), key)
    sizes = sizes.select(F.col(key).alias("_key"), F.least(F.col("_rows"), F.ceil(F.col("_rows") * F.col("_partners") / PAIRS_OF_A_TASK)).cast("int").alias("_parts"))
    tasks = min(100_000, 2 * int(sizes.agg(F.sum("_parts")).first()[0] or 1))
    left = rows.join(sizes, F.col(key) == F.col("_key")).withColumn("_part", F.pmod(F.xxhash64(tid), F.col("_parts")).cast("int")).drop("_key", "_parts")
    right = partners.join(sizes, F.col(key) == F.col("_key")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_key", "_parts")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])
    return left.repartition(tasks, key, "_part").join(right.repartition(tasks, f"{key}_", "_part_"), (F.col(key) == F.col(f"{key}_")) & (F.col("_part") == F.col("_part_"))).drop("_part", "_part_", f"{key}_")


def group_pairs(df: DataFrame, key: str, tid: str, columns: Iterable[str]) -> DataFrame:
    """Pairs of rows of one group with tid < tid_: the columns of the first, and of the second with _ behind their
    names.  A group of any size is many tasks', however few bytes it has."""
    names = list(dict.fromkeys([key, tid, *columns]))
    rows = df.select(*names)
    return dealt(rows, rows.withColumn("_one", F.lit(1)), key, tid, "_one").where(F.col(tid) < F.col(f"{tid}_")).drop("_one_")


# ---------------------------------------------------------------- foreign keys


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    other: str
    other_column: str


def key_paths(keys: list[ForeignKey], most: int) -> list[tuple[str, ...]]:
    """All paths of at most `most` tables along foreign keys, each named once."""
    step: dict[str, set[str]] = {}
    for k in keys:
        step.setdefault(k.table, set()).add(k.other)
    out, now = [], [(t,) for t in sorted({k.table for k in keys} | {k.other for k in keys})]
    while now:
        out += now
        now = [(*p, t) for p in now if len(p) < most for t in sorted(step.get(p[-1], ())) if t not in p]
    return out


def join_path(tables: dict[str, DataFrame], keys: list[ForeignKey], path: tuple[str, ...], how: str = "inner", columns: dict[str, list[str]] | None = None) -> DataFrame:
    """The tables of a path joined along their keys; columns are named table__column."""
    prefixed = lambda t: tables[t].select(*[F.col(c).alias(f"{t}__{c}") for c in tables[t].columns])
    out = prefixed(path[0])
    for a, b in zip(path, path[1:], strict=False):
        on = [F.col(f"{a}__{k.column}") == F.col(f"{b}__{k.other_column}") for k in keys if (k.table, k.other) == (a, b)]
        on += [F.col(f"{b}__{k.column}") == F.col(f"{a}__{k.other_column}") for k in keys if (k.table, k.other) == (b, a)]
        out = out.join(prefixed(b), reduce(lambda x, y: x & y, on), how)
    if columns:
        out = out.select(*[f"{t}__{c}" for t in path for c in columns.get(t, ())])
    return out


def join_graph(tables: dict[str, DataFrame], keys: list[ForeignKey], start: str, tids: dict[str, str]) -> DataFrame:
    """Full outer join of the row ids of all tables that foreign keys reach from start, breadth first; only ids
    and key columns are read, only ids (table__tid) come out."""
    usable = [k for k in keys if k.table in tables and k.other in tables]
    wanted = {t: {tids[t]} | {k.column for k in usable if k.table == t} | {k.other_column for k in usable if k.other == t} for t in tables}
    side = lambda t: tables[t].select(*[F.col(c).alias(f"{t}__{c}") for c in sorted(wanted[t])])
    out, seen, now = side(start), [start], [start]
    while now:
        after = []
        for t in now:
            for k in usable:
                new = k.other if k.table == t else k.table if k.other == t else None
                if new is None or new in seen:
                    continue
                out = out.join(side(new), F.col(f"{k.table}__{k.column}") == F.col(f"{k.other}__{k.other_column}"), "full_outer")
                seen.append(new)
                after.append(new)
        now = after
    return out.select(*[F.col(f"{t}__{tids[t]}") for t in seen])


def affordable(support: int, rows: int, most: float = 0.1) -> bool:
    """Whether pairs of one table may be built: not if there are more than a share of all n * n - n."""
    return support <= most * (rows * rows - rows)


def joint_tuples(left: DataFrame, key: str, right: DataFrame, other: str, tid: str) -> DataFrame:
    """For each tuple of left, the tuples of right that its key names."""
    pairs = left.select(key).distinct().join(right, F.col(key) == F.col(other))
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list(tid)).alias("partners"), F.count("*").alias("n"))


# ---------------------------------------------------------------- blocks


def labelled_rows(table: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return table.join(labels.select(key).distinct(), key, "left_semi")


def block_index(tokens: DataFrame, rid: str, token: str, shortest: int = 4, useless: float = 0.1) -> DataFrame:
    """token, rid of useful blocks: tokens of `shortest` characters or more, in at most a share of all records."""
    rows = tokens.where(F.length(token) >= shortest).select(F.col(rid).alias("rid"), F.col(token).alias("token")).distinct()
    total = tokens.agg((F.countDistinct(rid) * useless).alias("most"))  # one row
    size = rows.groupBy("token").agg(F.count("*").alias("n")).join(F.broadcast(total)).where("n <= most and n > 1").select("token")
    return rows.join(size, "token")


def candidate_pairs(tokens: DataFrame, rid: str, token: str, least: float, shortest: int = 4, useless: float = 0.1) -> DataFrame:
    """Pairs (a < b) by the Jaccard share of their tokens, counted over useful blocks."""
    blocks = block_index(tokens, rid, token, shortest, useless)
    size = tokens.select(F.col(rid).alias("rid"), F.col(token).alias("token")).distinct().groupBy("rid").agg(F.count("*").alias("size"))
    common = blocks.alias("x").join(blocks.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.rid") < F.col("y.rid"))).groupBy(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).agg(F.count("*").alias("shared"))
    sized = common.join(size.select(F.col("rid").alias("a"), F.col("size").alias("size_a")), "a").join(size.select(F.col("rid").alias("b"), F.col("size").alias("size_b")), "b")
    share = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    return sized.withColumn("jaccard", F.round(share, 9)).where(share >= least).select("a", "b", "shared", "jaccard")


def most_selective(tables: dict[str, DataFrame], predicates: list[Predicate], most: float | None = None) -> list[tuple[Predicate, int]]:
    """Equalities between tuples by their own support, smallest first (one job).  most: refuses, by an error, where
    even the first one gives more than that share of all pairs of its table."""
    parts = []
    for i, p in enumerate(predicates):
        f1 = histogram(tables[p.left.relation], p.left.column).select(F.col("value"), F.col("n").alias("n1"))
        f2 = histogram(tables[p.right.relation], p.right.column).select("value", F.col("n").alias("n2"))
        parts.append(f1.join(f2, "value").agg(F.coalesce(F.sum(F.col("n1").cast("decimal(38,0)") * F.col("n2")), F.lit(0)).alias("n")).withColumn("i", F.lit(i)))
    rows = reduce(DataFrame.unionByName, parts).collect() if parts else []  # a row for each predicate
    found = sorted(((predicates[r.i], int(r.n)) for r in rows), key=lambda x: (x[1], str(x[0])))
    if most is not None and found and len(found[0][0].relations) == 1:
        n = tables[found[0][0].left.relation].count()
        if not affordable(found[0][1] - n, n, most):
            raise ValueError(f"{found[0][0]} alone gives {found[0][1]} pairs of {n} rows")
    return found
