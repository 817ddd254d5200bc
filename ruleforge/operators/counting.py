"""Support and confidence by grouping, without ever building the tuple pairs.

For X over two tuples, keys are the values that X's equalities compare.  In a group of equal keys let n0
rows satisfy t0's constants, n1 those of t1 and nb both; then the ordered pairs of different rows that
satisfy X number ``n0 * n1 - nb``.  A pair right-hand side adds its column to the key.  All right-hand
sides of one X are counted in one pass by grouping sets.  Catalyst does not turn a count over a
self-join into aggregates, so the plan is built that way here; hot keys meet partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Operand, Predicate, compare, present
from .shared import ranged

BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Body:
    """X over t0 (of one relation) and t1 (of the same or another)."""

    keys: tuple[tuple[str, str], ...]
    constants: tuple[tuple[int, str, str, object], ...] = field(default=())

    @staticmethod
    def of(predicates: Iterable[Predicate]) -> Body:
        keys, constants = [], []
        for p in predicates:
            if p.is_constant:
                constants.append((p.left.variable, p.left.column, p.op, p.constant))
            elif p.op == "==" and not p.is_scored:
                p = p.canonical()
                keys.append((p.left.column, p.right.column))
            else:
                raise ValueError(f"grouping needs equalities: {p}")
        return Body(tuple(sorted(set(keys))), tuple(sorted(set(constants), key=str)))


def _present(df: DataFrame, names: Iterable[str]) -> Column:
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    ok = F.lit(True)
    for c in dict.fromkeys(names):
        ok = ok & present(F.col(c), c in text)
    return ok


def _meets(df: DataFrame, body: Body, variable: int) -> Column:
    ok = F.lit(True)
    for v, c, op, value in body.constants:
        if v == variable:
            ok = ok & F.coalesce(compare(F.col(c), op, F.lit(value)), F.lit(False))
    return ok


def histogram(df: DataFrame, column: str) -> DataFrame:
    """value -> count over present values."""
    return df.where(_present(df, [column])).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def predicate_support(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Support of one equality by itself: the sum of products of frequencies, self-pairs included."""
    f1 = histogram(left, a).select("value", F.col("n").alias("n1"))
    f2 = histogram(right, b).select("value", F.col("n").alias("n2"))
    return f1.join(f2, "value").agg(F.coalesce(F.sum(F.col("n1").cast(BIG) * F.col("n2")), F.lit(0)).cast(BIG).alias("support"))


def _pairs(n0: Column, n1: Column, nb: Column) -> Column:
    return n0.cast(BIG) * n1.cast(BIG) - nb.cast(BIG)


def count_rules(df: DataFrame, body: Body, rhs: list[Predicate]) -> DataFrame:
    """One relation: rows (rhs, support_x, support, rows0, rows1) for every right-hand side of one X.

    support of a constant right-hand side counts rows t0; rows0 and rows1 are the rows on each side that
    have a partner other than themselves.  Keys compare a column with itself.
    """
    if any(a != b for a, b in body.keys) or any(p.right and p.left.column != p.right.column for p in rhs):
        return count_across(df, df, body, rhs, same=True)
    keys = [f"k{i}" for i in range(len(body.keys))]
    pair = [p for p in rhs if not p.is_constant]
    unary = [p for p in rhs if p.is_constant]
    c0, c1 = _meets(df, body, 0), _meets(df, body, 1)
    rows = df.where(_present(df, [a for a, _ in body.keys]) & (c0 | c1)).select(
        *[F.col(a).alias(k) for (a, _), k in zip(body.keys, keys, strict=True)],
        *[F.when(_present(df, [p.left.column]), F.col(p.left.column)).alias(f"y{i}") for i, p in enumerate(pair)],
        c0.cast("int").alias("c0"), c1.cast("int").alias("c1"),
        *[F.coalesce(compare(F.col(p.left.column), p.op, F.lit(p.constant)), F.lit(False)).cast("int").alias(f"u{i}") for i, p in enumerate(unary)],
    )
    values = [f"y{i}" for i in range(len(pair))]
    sets = [[F.col(k) for k in keys]] + [[F.col(k) for k in [*keys, v]] for v in values]
    measures = [F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.sum(F.col("c0") * F.col("c1")).alias("nb")]
    measures += [m for i in range(len(unary)) for m in (F.sum(F.col("c0") * F.col(f"u{i}")).alias(f"u{i}"), F.sum(F.col("c0") * F.col("c1") * F.col(f"u{i}")).alias(f"v{i}"))]
    measures += [F.grouping(v).alias(f"g_{v}") for v in values]
    groups = rows.groupingSets(sets, *keys, *values).agg(*measures) if values else rows.groupBy(*keys).agg(*measures)
    whole = F.lit(True)
    for v in values:
        whole = whole & (F.col(f"g_{v}") == 1)
    n0, n1, nb = F.col("n0"), F.col("n1"), F.col("nb")
    with_partner = lambda n, other, both: F.when(other >= 2, n).when(other == 1, n - both).otherwise(0)
    of = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast(BIG)
    totals = groups.agg(
        of(_pairs(n0, n1, nb), whole).alias("support_x"), of(with_partner(n0, n1, nb), whole).alias("rows0"), of(with_partner(n1, n0, nb), whole).alias("rows1"),
        *[of(_pairs(n0, n1, nb), (F.col(f"g_{v}") == 0) & F.col(v).isNotNull()).alias(f"p_{v}") for v in values],
        *[of(with_partner(F.col(f"u{i}"), n1, F.col(f"v{i}")), whole).alias(f"p_u{i}") for i in range(len(unary))],
    )
    named = [(str(p), f"p_y{i}") for i, p in enumerate(pair)] + [(str(p), f"p_u{i}") for i, p in enumerate(unary)]
    return _unpivot(totals, named)


def _unpivot(totals: DataFrame, named: list[tuple[str, str]]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(t).alias("rhs"), F.col(c).alias("support")) for t, c in named])
    return totals.select(F.explode(entries).alias("e"), "support_x", "rows0", "rows1").select("e.rhs", "support_x", "e.support", "rows0", "rows1")


def count_across(left: DataFrame, right: DataFrame, body: Body, rhs: list[Predicate], same: bool = False) -> DataFrame:
    """The same for t0 in left and t1 in right, whose columns may differ: each side is grouped by its key,
    and only groups are joined.  same: both are one relation, so rows paired with themselves are taken off."""

    def counted(extra: Predicate | None) -> DataFrame:
        pairs = [*body.keys] + ([(extra.left.column, extra.right.column)] if extra else [])
        names = [f"k{i}" for i in range(len(pairs))]
        sides = []
        for v, df in ((0, left), (1, right)):
            own = [p[v] for p in pairs]
            part = df.where(_present(df, own) & _meets(df, body, v)).groupBy(*[F.col(c).alias(k) for c, k in zip(own, names, strict=True)])
            sides.append(part.agg(F.count("*").alias(f"n{v}")))
        joined = sides[0].join(sides[1], names)
        total = joined.agg(F.coalesce(F.sum(F.col("n0").cast(BIG) * F.col("n1")), F.lit(0)).cast(BIG).alias("n"))
        if same:
            itself = _present(left, [c for p in pairs for c in p]) & _meets(left, body, 0) & _meets(left, body, 1)
            for a, b in pairs:
                itself = itself & (F.col(a) == F.col(b))
            own_pairs = left.where(itself).agg(F.count("*").alias("own"))
            total = total.join(F.broadcast(own_pairs)).select((F.col("n") - F.col("own")).cast(BIG).alias("n"))  # one row each
        return total

    def partnered(v: int, extra: Predicate | None = None) -> DataFrame:
        """Number of rows of side v that have a partner other than themselves."""
        own, other = (left, right) if v == 0 else (right, left)
        mine, theirs = [k[v] for k in body.keys], [k[1 - v] for k in body.keys]
        names = [f"k{i}" for i in range(len(mine))]
        ok = _present(own, mine) & _meets(own, body, v)
        if extra:
            ok = ok & F.coalesce(compare(F.col(extra.left.column), extra.op, F.lit(extra.constant)), F.lit(False))
        itself = F.lit(False)
        if same:
            itself = _meets(own, body, 1 - v) & _present(own, theirs)
            for a, b in body.keys:
                itself = itself & (F.col(a) == F.col(b))
        partner = other.where(_present(other, theirs) & _meets(other, body, 1 - v)).groupBy(*[F.col(c).alias(k) for c, k in zip(theirs, names, strict=True)]).agg(F.count("*").alias("n"))
        rows = own.where(ok).select(*[F.col(c).alias(k) for c, k in zip(mine, names, strict=True)], F.coalesce(itself, F.lit(False)).cast("int").alias("itself"))
        return rows.join(partner, names).where(F.col("n") > F.col("itself")).agg(F.count("*").cast(BIG).alias("rows"))

    one_row = lambda a, b: a.join(F.broadcast(b))  # noqa: E731  both have one row
    base = one_row(one_row(counted(None).select(F.col("n").alias("support_x")), partnered(0).toDF("rows0")), partnered(1).toDF("rows1"))
    out = None
    for p in rhs:
        if p.is_constant:
            part = partnered(0, p).toDF("support")
        else:
            part = counted(p).select(F.col("n").alias("support"))
        row = base.join(F.broadcast(part)).select(F.lit(str(p)).alias("rhs"), "support_x", "support", "rows0", "rows1")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def with_confidence(counts: DataFrame) -> DataFrame:
    """Adds confidence (support over pairs, or over rows for a constant) and violations."""
    unary = ~F.col("rhs").rlike(r"\.t0\..*\.t1\.|\.t1\..*\.t0\.")
    base = F.when(unary, F.col("rows0")).otherwise(F.col("support_x"))
    share = F.col("support").cast("double") / base.cast("double")
    return counts.withColumn("confidence", F.when(base > 0, F.round(share, 9)).otherwise(F.lit(0.0))).withColumn("violations", (base - F.col("support")).cast(BIG))


def as_longs(counts: DataFrame) -> DataFrame:
    """Counters as longs; under ANSI rules a count beyond them is an error, not another number."""
    return counts.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in counts.schema])


#: Grouping sets of one pass; a level with more takes several.
MOST_SETS = 120


def count_level(df: DataFrame, candidates: dict[tuple[Predicate, ...], list[Predicate]]) -> dict[tuple[int, str], dict]:
    """Counters of all right-hand sides of all X of a level, X by number: (X, rhs) -> support_x, support, rows0, rows1.

    Keys compare a column with itself.  One pass: the projected rows are expanded into the key sets of all X,
    with and without each right-hand side's column, and counted by grouping sets; X with equal constants share
    measures.  A group of any size is one row after partial aggregation.
    """
    bodies = [Body.of(lhs) for lhs in candidates]
    out: dict[tuple[int, str], dict] = {}
    part, sets = [], set()
    for x, (body, rhs) in enumerate(zip(bodies, candidates.values(), strict=True)):
        keys = frozenset(a for a, _ in body.keys)
        own = {keys} | {keys | {p.left.column} for p in rhs if not p.is_constant}
        if part and len(sets | own) > MOST_SETS:
            out |= _count_sets(df, part, sets)
            part, sets = [], set()
        part.append((x, body, keys, rhs))
        sets |= own
    return out | _count_sets(df, part, sets) if part else out


def _count_sets(df: DataFrame, part: list, sets: set[frozenset[str]]) -> dict[tuple[int, str], dict]:
    columns = sorted({c for s in sets for c in s})
    fixed = sorted({body.constants for _, body, _, _ in part}, key=str)
    unary = sorted({p for *_, rhs in part for p in rhs if p.is_constant}, key=str)
    rows = df.select(
        *[F.when(_present(df, [c]), F.col(c)).alias(f"k{i}") for i, c in enumerate(columns)],
        *[_meets(df, Body((), f), v).cast("int").alias(f"c{v}_{j}") for j, f in enumerate(fixed) for v in (0, 1)],
        *[F.coalesce(compare(F.col(p.left.column), p.op, F.lit(p.constant)), F.lit(False)).cast("int").alias(f"u{m}") for m, p in enumerate(unary)],
    )
    key = {c: f"k{i}" for i, c in enumerate(columns)}
    measures = []
    for j in range(len(fixed)):
        c0, both = F.col(f"c0_{j}"), F.col(f"c0_{j}") * F.col(f"c1_{j}")
        measures += [F.sum(c0).alias(f"n0_{j}"), F.sum(f"c1_{j}").alias(f"n1_{j}"), F.sum(both).alias(f"nb_{j}")]
        measures += [e for m in range(len(unary)) for e in (F.sum(c0 * F.col(f"u{m}")).alias(f"u_{j}_{m}"), F.sum(both * F.col(f"u{m}")).alias(f"v_{j}_{m}"))]
    all_keys = [F.col(k) for k in key.values()]
    groups = rows.groupingSets([[F.col(key[c]) for c in sorted(s)] for s in sorted(sets, key=sorted)], *all_keys).agg(F.grouping_id().alias("gid"), *measures)
    whole = F.lit(True)  # no null among the columns of the set
    for i, k in enumerate(key.values()):
        whole = whole & (F.col(k).isNotNull() | F.col("gid").bitwiseAND(1 << len(columns) - 1 - i).cast("boolean"))
    with_partner = lambda n, other, both: F.when(other >= 2, n).when(other == 1, n - both).otherwise(0)
    totals = []
    for j in range(len(fixed)):
        n0, n1, nb = (F.col(f"{n}_{j}") for n in ("n0", "n1", "nb"))
        totals += [F.sum(_pairs(n0, n1, nb)).alias(f"p_{j}"), F.sum(with_partner(n0, n1, nb)).alias(f"r0_{j}"), F.sum(with_partner(n1, n0, nb)).alias(f"r1_{j}")]
        totals += [F.sum(with_partner(F.col(f"u_{j}_{m}"), n1, F.col(f"v_{j}_{m}"))).alias(f"s_{j}_{m}") for m in range(len(unary))]
    found = {r.gid: r for r in groups.where(whole).groupBy("gid").agg(*totals).collect()}  # a row for each set
    gid = lambda s: sum(1 << len(columns) - 1 - i for i, c in enumerate(columns) if c not in s)
    value = lambda s, name: int(found[gid(s)][name] or 0) if gid(s) in found else 0
    out = {}
    for x, body, keys, rhs in part:
        j = fixed.index(body.constants)
        base = {"support_x": value(keys, f"p_{j}"), "rows0": value(keys, f"r0_{j}"), "rows1": value(keys, f"r1_{j}")}
        for p in rhs:
            n = value(keys, f"s_{j}_{unary.index(p)}") if p.is_constant else value(keys | {p.left.column}, f"p_{j}")
            out[x, str(p)] = {**base, "support": n}
    return out


def count_pairs(tables: tuple[DataFrame, DataFrame], tids: tuple[str, str], lhs: Iterable[Predicate], rhs: list[Predicate], same: bool, scored: dict[str, DataFrame] | None = None) -> DataFrame:
    """The same for any X over two tuple variables: columns of two tables, order comparisons, scored predicates.

    Without scored predicates each side is grouped by the columns that matter and only groups meet, on all
    equalities of X as one hash key; rows paired with themselves are taken off.  With them, their pairs are
    the start, and fetch the columns of both sides.  X has an equality or a scored predicate.
    """
    lhs = list(lhs)
    plain = [p.canonical() for p in lhs if not p.is_scored]
    heads = [p.canonical() for p in rhs]
    if not any(p.is_scored or p.right and p.op == "==" for p in lhs):
        raise ValueError("X needs an equality or a scored predicate")
    need = [sorted({o.column for p in (*plain, *heads) for o in (p.left, p.right) if o and o.variable == v}) for v in (0, 1)]
    if same:
        need = [sorted({*need[0], *need[1]})] * 2
    text = [{f.name for f in t.schema if f.dataType.typeName() == "string"} for t in tables]
    name = lambda o, side=None: F.col(f"{'ab'[o.variable if side is None else side]}_{o.column}")

    def says(p: Predicate, side: int | None = None) -> Column:
        """The predicate over columns a_* (t0) and b_* (t1), or both on one side for a row by itself."""
        ok = present(name(p.left, side), p.left.column in text[p.left.variable])
        right = F.lit(p.constant) if p.is_constant else name(p.right, side)
        if p.right:
            ok = ok & present(right, p.right.column in text[p.right.variable])
        return F.coalesce(ok & compare(name(p.left, side), p.op, right), F.lit(False))

    def every(predicates, side: int | None = None) -> Column:
        ok = F.lit(True)
        for p in predicates:
            ok = ok & says(p, side)
        return ok

    columns = [[F.col(c).alias(f"{'ab'[v]}_{c}") for c in need[v]] for v in (0, 1)]
    pairs = [p for p in plain if p.right]
    one_sided = [[p for p in plain if p.is_constant and p.left.variable == v] for v in (0, 1)]
    own = None
    if len(plain) < len(lhs):
        first, *others = [scored[str(p)].select("tid0", "tid1").distinct() for p in lhs if p.is_scored]
        for o in others:
            first = first.join(o, ["tid0", "tid1"], "left_semi")
        sides = [tables[v].select(F.col(tids[v]).alias(f"tid{v}"), *columns[v]).where(every(one_sided[v])) for v in (0, 1)]
        joined = first.join(sides[0], "tid0").join(sides[1], "tid1").where(every(pairs))
        joined = (joined.where("tid0 <> tid1") if same else joined).withColumns({"n0": F.lit(1).cast(BIG), "n1": F.lit(1).cast(BIG), "itself": F.lit(0)})
        left = ["tid0"]
    else:
        sides = [tables[v].select(*columns[v]).where(every(one_sided[v])).groupBy(*[f"{'ab'[v]}_{c}" for c in need[v]]).agg(F.count("*").cast(BIG).alias(f"n{v}")) for v in (0, 1)]
        equal_ = [p for p in pairs if p.op == "=="]
        on = F.lit(True)
        for p in equal_:
            on = on & (name(p.left) == name(p.right))
        joined = sides[0].join(sides[1], on).where(every(pairs))
        itself = every(plain, 0) if same else F.lit(False)
        joined = joined.withColumn("itself", itself.cast("int"))
        left = [f"a_{c}" for c in need[0]]
        if same:
            rows = tables[0].select(*columns[0])
            own = rows.where(every(plain, 0)).agg(F.count("*").alias("own"), *[F.count(F.when(says(p, 0), 1)).alias(f"own{i}") for i, p in enumerate(heads) if p.right])
    n = (F.col("n0") * F.col("n1")).cast(BIG)
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(BIG)
    totals = joined.agg(of(n).alias("support_x"), *[of(F.when(says(p), n)).alias(f"s{i}") for i, p in enumerate(heads) if p.right])
    unary = [(i, p) for i, p in enumerate(heads) if p.is_constant]
    with_left = joined.groupBy(*left).agg(F.first("n0").alias("n0"), (F.sum("n1") - F.first("itself")).alias("partners"), *[F.first(says(p)).alias(f"u{i}") for i, p in unary])
    rows0 = with_left.where("partners > 0").agg(of(F.col("n0")).alias("rows0"), *[of(F.when(F.col(f"u{i}"), F.col("n0"))).alias(f"s{i}") for i, _ in unary])
    totals = totals.join(F.broadcast(rows0))  # one row each
    if own is not None:
        totals = totals.join(F.broadcast(own))
        totals = totals.withColumns({"support_x": (F.col("support_x") - F.col("own")).cast(BIG), **{f"s{i}": (F.col(f"s{i}") - F.col(f"own{i}")).cast(BIG) for i, p in enumerate(heads) if p.right}})
    entries = F.array(*[F.struct(F.lit(str(p)).alias("rhs"), F.col(f"s{i}").alias("support")) for i, p in enumerate(rhs)])
    return totals.select(F.explode(entries).alias("e"), "support_x", "rows0").select("e.rhs", "support_x", "e.support", "rows0", F.lit(None).cast(BIG).alias("rows1"))


def order_support(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """op, n for all six comparisons of t0.a with t1.b, over all pairs (self-pairs included).

    No pairs are built: both histograms are laid over one range-partitioned order, and the rows of each
    side before a value are sums over earlier partitions and within its own.
    """
    from pyspark.sql import Window

    sides = histogram(left, a).select("value", F.col("n").alias("n0"), F.lit(0).alias("n1")).unionByName(histogram(right, b).select("value", F.lit(0).alias("n0"), F.col("n").alias("n1")))
    both = sides.groupBy("value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    both = ranged(both, "value")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = both.groupBy("_part").agg(F.sum("n1").alias("s1")).select("_part", F.coalesce(F.sum("s1").over(earlier), F.lit(0)).alias("before"), F.sum("s1").over(Window.orderBy(F.lit(0))).alias("total"))
    within = F.coalesce(F.sum("n1").over(Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = both.withColumn("less", within).join(F.broadcast(before), "_part").withColumn("less", F.col("less") + F.col("before"))
    n0, n1, less, total = (F.col(c).cast(BIG) for c in ("n0", "n1", "less", "total"))
    more = total - less - n1
    counts = {"==": n1, "<>": total - n1, "<": more, "<=": more + n1, ">": less, ">=": less + n1}  # t0's value against t1's
    sums = rows.agg(*[F.coalesce(F.sum(n0 * c), F.lit(0)).cast(BIG).alias(f"c{i}") for i, c in enumerate(counts.values())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"c{i}").alias("n")) for i, op in enumerate(counts)])).alias("e")).select("e.*")


def scored_support(pairs: DataFrame) -> DataFrame:
    """Support of a scored predicate: the number of its pairs."""
    return pairs.distinct().agg(F.count("*").alias("support"))


def column_association(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """Unordered pairs that agree on lhs, and on lhs and rhs, from group sizes."""
    ok = df.where(_present(df, [*lhs, rhs]))
    half = lambda d, cols: d.groupBy(*cols).agg(F.count("*").alias("_size")).agg(F.coalesce(F.sum(F.col("_size").cast(BIG) * (F.col("_size") - 1) / 2), F.lit(0)).cast(BIG).alias("s"))
    x, both = half(ok, lhs), half(ok, [*lhs, rhs])
    out = x.select(F.col("s").alias("support_x")).join(F.broadcast(both.select(F.col("s").alias("support"))))  # one row each
    return out.withColumn("confidence", F.when(F.col("support_x") > 0, F.round(F.col("support") / F.col("support_x"), 9)).otherwise(F.lit(0.0)))


def equal(relation: str, column: str, other: str | None = None, other_column: str | None = None) -> Predicate:
    """rel.t0.column == other.t1.other_column"""
    return Predicate(Operand(relation, 0, column), "==", Operand(other or relation, 1, other_column or column))


def is_value(relation: str, column: str, value, variable: int = 0) -> Predicate:
    return Predicate(Operand(relation, variable, column), "==", constant=value)
