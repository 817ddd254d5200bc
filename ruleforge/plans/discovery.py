"""Level-wise discovery of rules, and recovery of their constants.

The lattice lives on the driver: candidates are a few thousand small objects.  The data never does.  All X of a
level that compare columns of one table with themselves share one pass over it (grouping sets, see counting.py);
X across tables or columns, with order comparisons or scored predicates, are counted from groups or from the
scored pairs, and X over three tuple variables from semi-joined chains, all of a kind in one job.  A job returns
one row of counters for each candidate.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.counting import BIG, Body, _present, as_longs, count_level, count_pairs, count_rules, with_confidence
from ..operators.joins import chain
from ..operators.predicates import Predicate, column_predicates, compare, constant_predicates, present
from ..operators.shared import checkpoint, ranged
from .rules import Rule, as_table

#: Weights of support, confidence, diversity, shortness and a subjective score.
WEIGHTS = (0.4, 0.2, 0.2, 0.1, 0.1)
#: Lowest confidence that keeps a candidate in the search, by level.
CONFIDENCE_BY_LEVEL = {0: 0.001, 1: 0.001, 2: 0.01}


@dataclass
class Interest:
    """Interestingness of rules; attributes that rules above used count against new ones."""

    n_rows: int
    weights: tuple[float, ...] = WEIGHTS
    subjective: Callable[[Rule], float] = lambda r: 0.0
    used: dict[str, int] = field(default_factory=dict)

    def diversity(self, predicates: Iterable[Predicate]) -> float:
        most = max((self.used.get(p.left.column, 100) for p in predicates), default=100)
        return 1 / (most + 1e-5)

    def _sum(self, support: float, confidence: float, predicates: list[Predicate], size: int, subjective: float) -> float:
        n = max(self.n_rows, 1)
        terms = (support / n / math.sqrt(n), confidence, self.diversity(predicates), 1 / max(size, 1), subjective)
        return sum(w * t for w, t in zip(self.weights, terms, strict=True))

    def score(self, r: Rule) -> float:
        return self._sum(r.support, r.confidence, [*r.lhs, r.rhs], len(r.lhs), self.subjective(r))

    def bound(self, support: int, size: int) -> float:
        """No rule of at most this support, and of a left-hand side of this size at least, scores more."""
        return self._sum(support, 1.0, [], size, 1.0)

    def count(self, rules: Iterable[Rule]) -> None:
        for r in rules:
            for c in {p.left.column for p in (*r.lhs, r.rhs)}:
                self.used[c] = self.used.get(c, 100) + 1


@dataclass
class Search:
    """State of a level-wise search."""

    support: int
    confidence: float
    valid: dict[Predicate, list[frozenset]] = field(default_factory=dict)
    failed: dict[Predicate, list[frozenset]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    #: What happened at each level: sets, candidates (set and right-hand side), passes and jobs over the data, and
    #: what each kind of pruning took away.
    log: list[dict] = field(default_factory=list)
    #: Every counted candidate: X, right-hand side, counters.
    counted: list[tuple[frozenset, Predicate, dict]] = field(default_factory=list)

    def open(self, lhs: frozenset, rhs: Predicate) -> bool:
        """Neither implied by a shorter valid rule nor below a candidate without support."""
        return rhs not in lhs and not any(s <= lhs for s in itertools.chain(self.valid.get(rhs, ()), self.failed.get(rhs, ())))


def compatible(lhs: frozenset[Predicate]) -> bool:
    """One constant for each variable and column, one comparison for each pair of operands, and one relation for
    each variable."""
    places = [(p.left.variable, p.left.column) for p in lhs if p.is_constant]
    pairs = [(p.left, p.right, p.model) for p in lhs if p.right]
    relations = {(o.variable, o.relation) for p in lhs for o in (p.left, p.right) if o}
    return len(places) == len(set(places)) and len(pairs) == len(set(pairs)) and len({v for v, _ in relations}) == len(relations)


def linked(lhs: Iterable[Predicate]) -> bool:
    """t0 and t1 are compared, and every further variable is compared with one that is reached."""
    pairs = [p.variables for p in lhs if p.right]
    reached, used = {0}, {v for p in lhs for v in p.variables}
    while more := [v for v in pairs if v & reached and not v <= reached]:
        reached = reached.union(*more)
    return frozenset((0, 1)) in pairs and used <= reached


def groupable(lhs: Iterable[Predicate]) -> bool:
    """Group sizes of one table give all counts: columns are compared with themselves, by equality."""
    return all(p.is_constant or (p.op == "==" and not p.is_scored and p.variables == {0, 1} and p.left.relation == p.right.relation and p.left.column == p.right.column) for p in lhs)


def countable(lhs: frozenset[Predicate], rhs: Predicate) -> bool:
    """X compares the tuples at least once; a right-hand side is on t0 or on the pair, of X's relations, and says
    nothing about a column that a constant of X already fixes."""
    if not linked(lhs) or rhs.is_constant and rhs.left.variable != 0:
        return False
    relation = {o.variable: o.relation for p in lhs for o in (p.left, p.right) if o}
    if any(relation.get(o.variable) != o.relation for o in (rhs.left, rhs.right) if o):
        return False
    keyed = any(p.right and p.variables == {0, 1} and (p.op == "==" or p.is_scored) for p in lhs)
    if not keyed and (rhs.is_constant or rhs.op != "==" or sum(p.right is not None for p in lhs) > 1):
        return False  # one order comparison may stand alone, where the right-hand side is a key
    if any(p.right and (p.left, p.right) == (rhs.left, rhs.right) for p in lhs):
        return False
    fixed = {p.left.column for p in lhs if p.is_constant}
    return not (rhs.is_constant and (rhs.left.column in fixed or any(p.right and p.left.column == rhs.left.column for p in lhs)))


def expand(level: list[frozenset], kept: set[frozenset]) -> list[frozenset]:
    """Sets of one more predicate, all of whose subsets of this size were kept (all-constant sets, sets that leave
    a variable unlinked and sets with a contradiction of constants are no subsets to look for)."""
    out = set()
    singles = sorted({p for s in level for p in s}, key=str)
    for s in level:
        for p in singles:
            if p in s or not p.variables <= {0, 1}.union(*(q.variables for q in s)):
                continue
            t = s | {p}
            if t not in out and compatible(t) and all(u in kept or not linked(u) for u in (t - {q} for q in t)):
                out.add(t)
    return sorted(out, key=lambda s: sorted(map(str, s)))


def by_template(lhs: frozenset, rhs: Predicate, valid: dict[Predicate, list[frozenset]]) -> bool:
    """Whether a valid rule with constants covers the candidate's template: its comparisons are among the
    candidate's, and it fixes every column that the candidate fixes, whatever the values.  Recovery finds the
    others."""
    place = lambda p: (p.left.variable, p.left.column)
    pairs, fixed = {p for p in lhs if p.right}, {place(p) for p in lhs if p.is_constant}
    return any(any(p.is_constant for p in s) and {p for p in s if p.right} <= pairs and fixed <= {place(p) for p in s if p.is_constant} for s in valid.get(rhs, ()))


@dataclass
class Source:
    """The tables of a search, their row ids, and the pairs (tid0, tid1) of scored predicates by text."""

    tables: dict[str, DataFrame]
    tids: dict[str, str]
    scored: dict[str, DataFrame] = field(default_factory=dict)

    def count(self, todo: dict[frozenset, list[Predicate]], log: dict) -> dict[tuple[frozenset, Predicate], dict]:
        """Counters of all candidates of a level."""
        out: dict[tuple[frozenset, Predicate], dict] = {}
        grouped: dict[str, dict] = {}
        other: list[tuple[frozenset, list[Predicate]]] = []
        for s, rhs in sorted(todo.items(), key=lambda kv: sorted(map(str, kv[0]))):
            plain = [p for p in rhs if groupable(s) and groupable([p])]
            if plain:
                grouped.setdefault(next(p for p in s if p.right).left.relation, {})[s] = plain
            if len(plain) < len(rhs):
                other.append((s, [p for p in rhs if p not in plain]))
        for relation, part in grouped.items():
            sets = list(part)
            counts = count_level(self.tables[relation], {tuple(sorted(s, key=str)): part[s] for s in sets})
            out |= {(s, p): counts[x, str(p)] for x, s in enumerate(sets) for p in part[s]}
            log["jobs"] += 1
        log["passes"] += len(grouped) + len(other)
        for i in range(0, len(other), 16):
            some = other[i : i + 16]
            rows = None
            for x, (s, rhs) in enumerate(some):
                one = self._pairs(s, rhs).withColumn("x", F.lit(x))
                rows = one if rows is None else rows.unionByName(one)
            log["jobs"] += 1
            by = {(r.x, r.rhs): r for r in rows.collect()}  # one row a candidate
            for x, (s, rhs) in enumerate(some):
                for p in rhs:
                    r = by[x, str(p)]
                    out[s, p] = {"support_x": int(r.support_x), "support": int(r.support), "rows0": int(r.rows0)}
        return out

    def _pairs(self, lhs: frozenset, rhs: list[Predicate]) -> DataFrame:
        relation = {o.variable: o.relation for p in lhs for o in (p.left, p.right) if o}
        if len(relation) > 2:
            names = [relation[v] for v in range(len(relation))]
            return count_chain([self.tables[n] for n in names], [self.tids[n] for n in names], sorted(lhs, key=str), rhs)
        pair, tids = (self.tables[relation[0]], self.tables[relation[1]]), (self.tids[relation[0]], self.tids[relation[1]])
        same = relation[0] == relation[1]
        if any(p.right and p.op != "==" and not p.is_scored for p in rhs) and by_classes([*pair], sorted(lhs, key=str), rhs):
            return count_classes([*pair], sorted(lhs, key=str), [p.canonical() for p in rhs])
        if any(p.right and (p.op == "==" or p.is_scored) for p in lhs):
            return count_pairs(pair, tids, sorted(lhs, key=str), rhs, same, self.scored)
        # one order comparison: all its pairs from the sorted histograms, and those of the right-hand side by its key
        from ..operators.counting import order_support

        p = next(p for p in lhs if p.right)
        out = None
        for q in rhs:
            both = count_pairs(pair, tids, [*sorted(lhs, key=str), q], [q], same, self.scored).select("support", "rows0")
            sides = [pair[v].where(reduce_and([self._holds(c, pair[v]) for c in lhs if c.is_constant and c.left.variable == v])) for v in (0, 1)]
            total = order_support(sides[0], p.left.column, sides[1], p.right.column).where(F.col("op") == p.op).select(F.col("n").alias("support_x"))
            if same:
                own = [self._holds(c, pair[0]) for c in lhs if c.is_constant] + [_present(pair[0], [p.left.column, p.right.column]), compare(F.col(p.left.column), p.op, F.col(p.right.column))]
                itself = pair[0].where(reduce_and(own)).agg(F.count("*").alias("own"))
                total = total.join(F.broadcast(itself)).select((F.col("support_x") - F.col("own")).cast(BIG).alias("support_x"))  # one row each
            part = total.join(F.broadcast(both)).select(F.lit(str(q)).alias("rhs"), "support_x", "support", F.lit(0).cast(BIG).alias("rows0"), F.lit(None).cast(BIG).alias("rows1"))
            out = part if out is None else out.unionByName(part)
        return out

    @staticmethod
    def _holds(p: Predicate, table: DataFrame):
        return present(F.col(p.left.column), table.schema[p.left.column].dataType.typeName() == "string") & compare(F.col(p.left.column), p.op, F.lit(p.constant))


def reduce_and(conditions: list):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def mine(
    source: Source, pairs: list[Predicate], fixed: list[Predicate], heads: list[Predicate], support: int = 1, confidence: float = 0.9, levels: int = 3, top: int | None = None, variables: int = 2,
    weights: tuple[float, ...] = WEIGHTS, listed: set[tuple[str, str]] | None = None, prune: Callable[[frozenset, Predicate], bool] | None = None, confidence_filter: bool = False, templates: bool = False,
    learn: Callable[[frozenset, Predicate, dict], None] | None = None, bounded: bool = True,
) -> Search:
    """The search over X of `pairs` (comparisons of t0 and t1, of any tables, any operator, scored or not) and
    `fixed` (constants on t0 and t1) for rules with right-hand sides `heads`.

    listed: pairs (predicate, right-hand side) that may go together, if given; prune: a learned filter that drops
    candidates; learn: called with every counted candidate, e.g. to train that filter; confidence_filter:
    candidates whose confidence is hopeless for their level are not expanded; templates: right-hand sides that
    valid rules with constants cover are dropped; top: only so many rules, pruned by the score's upper bound over
    X's own support (unless bounded is False); variables: X may reach a third tuple variable by an equality.
    """
    search = Search(support, confidence)
    interest = Interest(max(t.count() for t in source.tables.values()), weights)
    level = [frozenset([p]) for p in pairs] + [frozenset([p]) for p in fixed]
    edges = [p for p in pairs if p.op == "==" and not p.is_scored]
    open_heads: dict[frozenset, frozenset] = {}
    for depth in range(1, levels + 1):
        log = {"level": depth, "sets": len(level), "candidates": 0, "passes": 0, "jobs": 0, "by_support": 0, "valid": 0, "by_parents": 0, "by_bound": 0, "by_filter": 0, "by_confidence": 0, "by_template": 0}
        todo = {}
        for lhs in level:
            # a set's right-hand sides are those that all its subsets left open
            parents = [(lhs, open_heads[u] | {p for p in heads if not countable(u, p)}) for u in (lhs - {q} for q in lhs) if u in open_heads]
            allowed = shared_heads(parents)[lhs] if parents else frozenset(heads)
            rhs = []
            for p in heads:
                if not countable(lhs, p):
                    continue
                if p not in allowed or not search.open(lhs, p):
                    log["by_parents"] += 1
                elif listed is not None and not all((str(q), str(p)) in listed for q in lhs) or prune and prune(lhs, p):
                    log["by_filter"] += 1
                elif templates and by_template(lhs, p, search.valid):
                    log["by_template"] += 1
                else:
                    rhs.append(p)
            if rhs:
                todo[lhs] = rhs
        counts = source.count(todo, log)
        log["candidates"] = len(counts)
        alive, reach = set(), {}
        for lhs, rhs in todo.items():
            total = max(counts[lhs, p]["support_x"] for p in rhs)
            reach[lhs] = max([total] + [counts[lhs, p]["rows0"] * interest.n_rows for p in rhs if p.is_constant])
            if total >= support:
                alive.add(lhs)
            hopeful, left = False, set()
            for p in rhs:
                c = counts[lhs, p]
                base = c["rows0"] if p.is_constant else c["support_x"]
                c["confidence"] = round(c["support"] / base, 9) if base else 0.0
                c["violations"] = base - c["support"]
                search.counted.append((lhs, p, c))
                if learn:
                    learn(lhs, p, c)
                n = c["support"] * (interest.n_rows if p.is_constant else 1)
                if n < support:
                    search.failed.setdefault(p, []).append(lhs)
                    log["by_support"] += 1
                elif c["confidence"] >= confidence:
                    search.valid.setdefault(p, []).append(lhs)
                    search.rules.append(Rule.of(lhs, p, support=n, confidence=c["confidence"], violations=c["violations"]))
                    log["valid"] += 1
                else:
                    left.add(p)
                    hopeful = hopeful or c["confidence"] >= CONFIDENCE_BY_LEVEL.get(depth, 0.1)
            open_heads[lhs] = frozenset(left)
            if confidence_filter and not hopeful and lhs in alive:
                alive.discard(lhs)
                log["by_confidence"] += 1
        if top is not None and bounded and len(search.rules) >= top:
            floor = best(search.rules, interest, top)[-1].score
            hopeless = {s for s in alive if interest.bound(reach[s], len(s) + 1) < floor}
            log["by_bound"], alive = len(hopeless), alive - hopeless
        search.log.append(log)
        # sets that no right-hand side could be counted for yet only wait for a comparison
        waiting = {s for s in level if s not in todo and (depth == 1 or any(p.right for p in s)) and not any(countable(s, p) for p in heads)}
        kept = alive | waiting
        wider = [t for s in sorted(alive, key=lambda s: sorted(map(str, s))) for t in with_new_variable(s, edges, variables) if compatible(t)] if depth < levels else []
        level = list(dict.fromkeys(expand([s for s in level if s in kept], kept) + wider))
        if not level:
            break
    search.rules = best(search.rules, interest, top)
    return search


def discover(
    df: DataFrame, relation: str, columns: list[str], constants: dict[str, list] | None = None, support: int = 1, confidence: float = 0.9, levels: int = 3, top: int | None = None, constant_rhs: bool = False, **options,
) -> list[Rule]:
    """Minimal rules over two tuples of one table by equality, with enough support and confidence, best first.
    Options are those of mine()."""
    pairs = [p for p in column_predicates(relation, dict.fromkeys(columns, "text")) if p.op == "=="]
    fixed = constant_predicates(relation, constants or {})
    heads = pairs + ([p for p in fixed if p.left.variable == 0] if constant_rhs else [])
    return mine(Source({relation: df}, {}), pairs, fixed, heads, support, confidence, levels, top, **options).rules


def best(rules: list[Rule], interest: Interest, top: int | None = None) -> list[Rule]:
    """Rules by score, ties by text."""
    scored = [Rule(r.lhs, r.rhs, r.support, r.confidence, interest.score(r), r.violations) for r in rules]
    return sorted(scored, key=lambda r: (-r.score, str(r)))[:top]


def discover_table(df: DataFrame, relation: str, columns: list[str], **options) -> DataFrame:
    return as_table(df.sparkSession, discover(df, relation, columns, **options))


def evaluate(df: DataFrame, rules: list[tuple[list[Predicate], Predicate]]) -> DataFrame:
    """rule number, support_x, support, confidence of given rules, in one plan."""
    out = None
    for i, (lhs, rhs) in enumerate(rules):
        part = as_longs(with_confidence(count_rules(df, Body.of(lhs), [rhs]))).withColumn("rule", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def count_chain(tables: list[DataFrame], tids: list[str], lhs: list[Predicate], rhs: list[Predicate]) -> DataFrame:
    """rhs, support_x, support, rows0 of rules over three or more tuple variables: pairs (t0, t1) for which rows of
    the other variables exist, and those of them that satisfy each right-hand side."""
    if by_classes(tables, lhs, rhs):
        return count_classes(tables, lhs, [p.canonical() for p in rhs])
    side = lambda v: tables[v].select(F.col(tids[v]).alias(f"tid{v}"), *[F.when(_present(tables[v], [c]), F.col(c)).alias(f"y{v}_{c}") for c in sorted({o.column for p in rhs for o in (p.left, p.right) if o and o.variable == v})])
    rows = chain(tables, tids, lhs).join(side(0), "tid0").join(side(1), "tid1")
    value = lambda o: F.col(f"y{o.variable}_{o.column}")
    holds = [compare(value(p.left), p.op, F.lit(p.constant) if p.is_constant else value(p.right)) for p in rhs]
    by_row = rows.groupBy("tid0").agg(F.count("*").alias("n"), *[(F.max(h.cast("int")) if p.is_constant else F.count(F.when(h, 1))).alias(f"s{i}") for i, (p, h) in enumerate(zip(rhs, holds, strict=True))])
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(BIG)
    totals = by_row.agg(of("n").alias("support_x"), F.count("*").cast(BIG).alias("rows0"), *[of(f"s{i}").alias(f"s{i}") for i in range(len(rhs))])
    entries = F.array(*[F.struct(F.lit(str(p)).alias("rhs"), F.col(f"s{i}").alias("support")) for i, p in enumerate(rhs)])
    return totals.select(F.explode(entries).alias("e"), "support_x", "rows0").select("e.rhs", "support_x", "e.support", "rows0", F.lit(None).cast(BIG).alias("rows1"))


def by_classes(tables: list[DataFrame], lhs: list[Predicate], rhs: list[Predicate]) -> bool:
    """Whether count_classes() gives the counts: two or three variables, t0 and t1 equated in X, X of equalities and
    constants, and right-hand sides on t0 or on pairs whose values have an order in common."""
    numbers = {"byte", "short", "integer", "long", "float", "double"}

    def alike(p: Predicate) -> bool:
        a, b = (tables[o.variable].schema[o.column].dataType for o in (p.left, p.right))
        return a == b and a.typeName() not in ("array", "map", "struct", "binary") or {a.typeName(), b.typeName()} <= numbers

    plain = all(not p.is_scored and (p.is_constant or p.op == "==") for p in lhs)
    heads = all(not p.is_scored and (p.left.variable == 0 if p.is_constant else p.variables == {0, 1} and alike(p)) for p in rhs)
    return len(tables) <= 3 and plain and heads and any(p.variables == {0, 1} for p in lhs)


def count_classes(tables: list[DataFrame], lhs: Iterable[Predicate], rhs: list[Predicate]) -> DataFrame:
    """count_chain() from group sizes.

    Rows fall into classes by the columns that X compares (also those that decide whether a row is its own third
    one); only classes meet, and a pair of classes counts if the rows of the third table with its values are more than
    the two themselves.  A right-hand side over the pair is counted from the values of both classes laid in one order,
    in range partitions, by how many partners come before each: no pairs of rows or of values are built.
    """
    edges, fixed = [p for p in lhs if p.right], [p for p in lhs if p.is_constant]
    text = [{f.name for f in t.schema if f.dataType.typeName() == "string"} for t in tables]
    same = lambda u, v: u == v or v < len(tables) and tables[u] is tables[v]
    used = [{o.column for p in lhs for o in (p.left, p.right) if o and o.variable == v} for v in range(len(tables))]
    need = [sorted(set().union(*(used[w] for w in range(len(tables)) if same(v, w) or same(w, v)))) for v in range(len(tables))]
    here = lambda v, c, side=None: F.col(f"{'abc'[v if side is None else side]}_{c}")

    def there(v: int, side: int | None = None):
        """The row holds X's constants of variable v."""
        return reduce_and([F.coalesce(present(here(v, p.left.column, side), p.left.column in text[v]) & compare(here(v, p.left.column, side), p.op, F.lit(p.constant)), F.lit(False)) for p in fixed if p.left.variable == v])

    def says(p: Predicate, sides: dict[int, int]):
        """An equality of X, with the columns of each variable taken from a side."""
        o, q = p.left, p.right
        a, b = here(o.variable, o.column, sides.get(o.variable)), here(q.variable, q.column, sides.get(q.variable))
        return F.coalesce(present(a, o.column in text[o.variable]) & present(b, q.column in text[q.variable]) & (a == b), F.lit(False))

    def rows(v: int, *more) -> DataFrame:
        return tables[v].select(*[F.col(c).alias(f"{'abc'[v]}_{c}") for c in need[v]], *more).where(there(v))

    def key(v: int) -> list[str]:
        return [f"{'abc'[v]}_{c}" for c in need[v]]

    unary = [(i, p) for i, p in enumerate(rhs) if p.is_constant]
    own = lambda p: F.coalesce(present(F.col(p.left.column), p.left.column in text[0]) & compare(F.col(p.left.column), p.op, F.lit(p.constant)), F.lit(False)).cast("int")
    left = rows(0, *[own(p).alias(f"u{i}") for i, p in unary]).groupBy(*key(0)).agg(F.count("*").cast(BIG).alias("n0"), *[F.sum(f"u{i}").cast(BIG).alias(f"u{i}") for i, _ in unary])
    right = rows(1).groupBy(*key(1)).agg(F.count("*").cast(BIG).alias("n1"))
    met = lambda ps: reduce_and([here(p.left.variable, p.left.column) == here(p.right.variable, p.right.column) for p in ps])
    direct = [p for p in edges if p.variables == {0, 1}]
    pairs = left.join(right, met(direct)).where(reduce_and([says(p, {}) for p in direct]))
    if len(tables) == 3:
        third = [p for p in edges if 2 in p.variables]
        columns = [f"c_{c}" for c in sorted({o.column for p in third for o in (p.left, p.right) if o.variable == 2})]
        others = rows(2).groupBy(*columns).agg(F.count("*").cast(BIG).alias("n2"))
        pairs = pairs.join(others, met(third)).where(reduce_and([says(p, {}) for p in third]))
        for v in (0, 1):
            if same(v, 2):  # the row itself is no third one
                itself = there(2, v) & reduce_and([says(p, {2: v}) for p in third])
                pairs = pairs.withColumn("n2", F.col("n2") - itself.cast("int"))
        pairs = pairs.where("n2 > 0")
    alone = reduce_and([here(0, c).eqNullSafe(here(1, c)) for c in need[0]]) if same(0, 1) else F.lit(False)
    pairs = checkpoint(pairs.select(*key(0), *key(1), "n0", "n1", *[f"u{i}" for i, _ in unary], alone.cast("int").alias("itself")))
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(BIG)
    totals = pairs.agg(of(F.col("n0") * F.col("n1") - F.col("n0") * F.col("itself")).alias("support_x"))
    by_left = pairs.groupBy(*key(0)).agg(F.first("n0").alias("n0"), F.sum(F.col("n1") - F.col("itself")).alias("partners"), *[F.first(f"u{i}").alias(f"u{i}") for i, _ in unary])
    totals = totals.join(F.broadcast(by_left.where("partners > 0").agg(of("n0").alias("rows0"), *[of(f"u{i}").alias(f"s{i}") for i, _ in unary])))  # one row each
    for i, p in enumerate(rhs):
        if p.right:
            totals = totals.join(F.broadcast(_head_pairs(tables, p, pairs, rows, key, same(0, 1)).withColumnRenamed("n", f"s{i}")))
    entries = F.array(*[F.struct(F.lit(str(p)).alias("rhs"), F.col(f"s{i}").alias("support")) for i, p in enumerate(rhs)])
    return totals.select(F.explode(entries).alias("e"), "support_x", "rows0").select("e.rhs", "support_x", "e.support", "rows0", F.lit(None).cast(BIG).alias("rows1"))


def _head_pairs(tables: list[DataFrame], p: Predicate, pairs: DataFrame, rows: Callable, key: Callable, same: bool) -> DataFrame:
    """n: the pairs of different rows, of the given pairs of classes, that satisfy p."""
    classes = [*key(0), *key(1)]
    named = pairs.select(*classes).withColumn("_pair", F.struct(*classes))
    sides = []
    for v, o in ((0, p.left), (1, p.right)):
        values = rows(v, F.when(_present(tables[v], [o.column]), F.col(o.column)).alias("_value")).where("_value is not null").groupBy(*key(v), "_value").agg(F.count("*").cast(BIG).alias("_n"))
        of_class = named.select(*[F.col(c).alias(f"_{c}") for c in key(v)], "_pair")
        met = of_class.join(values, reduce_and([F.col(f"_{c}").eqNullSafe(F.col(c)) for c in key(v)]))
        sides.append(met.select("_pair", "_value", *[(F.col("_n") if v == w else F.lit(0).cast(BIG)).alias(f"_n{w}") for w in (0, 1)]))
    both = sides[0].unionByName(sides[1]).groupBy("_pair", "_value").agg(F.sum("_n0").cast(BIG).alias("_n0"), F.sum("_n1").cast(BIG).alias("_n1"))
    if p.op == "==":
        total = both.agg(F.coalesce(F.sum(F.col("_n0") * F.col("_n1")), F.lit(0)).cast(BIG).alias("n"))
    else:
        both = ranged(both, "_pair", "_value")
        of_pair = Window.partitionBy("_pair")
        earlier = of_pair.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = both.groupBy("_pair", "_part").agg(F.sum("_n1").cast(BIG).alias("_s")).select("_pair", "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).cast(BIG).alias("_before"), F.sum("_s").over(of_pair).cast(BIG).alias("_all"))
        within = Window.partitionBy("_pair", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
        less = both.withColumn("_within", F.coalesce(F.sum("_n1").over(within), F.lit(0)).cast(BIG)).join(parts, ["_pair", "_part"])
        less = less.withColumn("_less", (F.col("_within") + F.col("_before")).cast(BIG))
        below, equal_, whole = F.col("_less"), F.col("_n1"), F.col("_all")  # t1's values against t0's
        partners = {"<>": whole - equal_, "<": whole - below - equal_, "<=": whole - below, ">": below, ">=": below + equal_}[p.op]
        total = less.agg(F.coalesce(F.sum(F.col("_n0") * partners.cast(BIG)), F.lit(0)).cast(BIG).alias("n"))
    if not same:
        return total
    itself = F.coalesce(_present(tables[0], [p.left.column, p.right.column]) & compare(F.col(p.left.column), p.op, F.col(p.right.column)), F.lit(False))
    alone = rows(0, itself.alias("_holds")).where("_holds").groupBy(*key(0)).agg(F.count("*").alias("_own"))
    own = pairs.where("itself = 1").select(*[F.col(c).alias(f"_{c}") for c in key(0)]).join(alone, reduce_and([F.col(f"_{c}").eqNullSafe(F.col(c)) for c in key(0)])).agg(F.coalesce(F.sum("_own"), F.lit(0)).alias("_own"))
    return total.join(F.broadcast(own)).select((F.col("n") - F.col("_own")).cast(BIG).alias("n"))  # one row each


def evaluate_chain(tables: list[DataFrame], tids: list[str], lhs: list[Predicate], rhs: Predicate) -> DataFrame:
    """support_x, support, confidence of one rule over three or more tuple variables."""
    out = as_longs(with_confidence(count_chain(tables, tids, lhs, [rhs])))
    return out.select("rows0" if rhs.is_constant else "support_x", "support", "confidence").toDF("support_x", "support", "confidence")


def with_new_variable(lhs: frozenset, edges: Iterable[Predicate], most: int) -> list[frozenset]:
    """X with an edge from one of its tuple variables to a new one, if `most` variables allow it."""
    relation = {o.variable: o.relation for p in lhs for o in (p.left, p.right) if o}
    new = max(relation) + 1
    if new >= most or not all(p.is_constant or p.op == "==" and not p.is_scored for p in lhs):
        return []
    found = []
    for p in edges:
        for q in dict.fromkeys((p, p.mirrored())):
            found += [lhs | {q.at(v, new)} for v in sorted(relation) if q.left.relation == relation[v]]
    return list(dict.fromkeys(found))


def shared_heads(vertices: Iterable[tuple[frozenset, frozenset]]) -> dict[frozenset, frozenset]:
    """Candidate sets with their right-hand sides; a set met twice keeps those that both allow."""
    out: dict[frozenset, frozenset] = {}
    for lhs, heads in vertices:
        out[lhs] = out[lhs] & heads if lhs in out else heads
    return out


def evaluate_ids(df: DataFrame, vocabulary: list[Predicate], text: str) -> DataFrame:
    """The same for rules given as predicate numbers: "5 25,2;3,1" has two rules, X numbers then the right-hand side's."""
    rules = []
    for r in text.split(";"):
        lhs, rhs = r.split(",")
        rules.append(([vocabulary[int(i)] for i in lhs.split()], vocabulary[int(rhs)]))
    return evaluate(df, rules)


def expected_support(rate: float, rows: int) -> int:
    """The support threshold for a rate of all pairs."""
    return int(rate * rows * rows)


# ---------------------------------------------------------------- constant recovery


def template(r: Rule) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], Predicate]:
    """A rule with its constants freed: key columns, columns fixed on t0 and on t1, right-hand side."""
    keys = tuple(sorted(p.left.column for p in r.lhs if p.right))
    fixed = lambda v: tuple(sorted(p.left.column for p in r.lhs if p.is_constant and p.left.variable == v))
    return keys, fixed(0), fixed(1), r.rhs


def recover(df: DataFrame, keys: Iterable[str], fixed0: Iterable[str], fixed1: Iterable[str], rhs: str, support: int, confidence: float) -> DataFrame:
    """All values of the freed constants for which the rule with a pair right-hand side holds: c0_<column>,
    c1_<column>, support_x, support, confidence.

    Each side is grouped by key and its constants, once without and once with the right-hand side; the
    groups of both sides meet on the key.  Where both sides fix the same columns and a binding gives them
    equal values, rows meet themselves and are taken off.
    """
    keys, fixed0, fixed1 = list(keys), list(fixed0), list(fixed1)
    def groups(v: int, fixed: list[str], extra: list[str]) -> DataFrame:
        names = [F.col(k).alias(f"k_{k}") for k in [*keys, *extra]] + [F.col(c).alias(f"c{v}_{c}") for c in fixed]
        return df.where(_present(df, [*keys, *extra, *fixed])).groupBy(*names).agg(F.count("*").alias(f"n{v}"))

    def pairs(extra: list[str], name: str) -> DataFrame:
        on = [f"k_{k}" for k in [*keys, *extra]]
        joined = groups(0, fixed0, extra).join(groups(1, fixed1, extra), on)
        # rows that satisfy both sides' constants meet themselves
        own = df.where(_present(df, [*keys, *extra, *fixed0, *fixed1]))
        own = own.groupBy(*[F.col(c).alias(f"c0_{c}") for c in fixed0], *[F.col(c).alias(f"c1_{c}") for c in fixed1]).agg(F.count("*").alias("own"))
        bindings = [f"c0_{c}" for c in fixed0] + [f"c1_{c}" for c in fixed1]
        total = joined.groupBy(*bindings).agg(F.sum(F.col("n0").cast(BIG) * F.col("n1")).alias("all"))
        return total.join(own, bindings, "left").select(*bindings, (F.col("all") - F.coalesce("own", F.lit(0))).cast(BIG).alias(name))

    bindings = [f"c0_{c}" for c in fixed0] + [f"c1_{c}" for c in fixed1]
    out = pairs([], "support_x").join(pairs([rhs], "support"), bindings)
    out = out.withColumn("confidence", F.round(F.try_divide(F.col("support").cast("double"), F.col("support_x").cast("double")), 9))
    return out.where((F.col("support") >= support) & (F.col("confidence") >= confidence))


def recover_head(df: DataFrame, keys: Iterable[str], fixed: Iterable[str], rhs: str, support: int, confidence: float, fixed1: Iterable[str] = ()) -> DataFrame:
    """For a right-hand side t0.rhs == constant with the constant free: for every binding of the constants of t0
    and t1, the most frequent value among rows t0 with such a partner (ties: the least), if it is frequent enough.
    """
    keys, fixed, fixed1 = list(keys), list(fixed), list(fixed1)
    names, others = [f"c0_{c}" for c in fixed], [f"c1_{c}" for c in fixed1]
    rows = df.where(_present(df, [*keys, *fixed]))
    own = [F.when(_present(df, [c]), F.col(c)).alias(f"_own_{c}") for c in fixed1]
    value = F.when(_present(df, [rhs]), F.col(rhs)).alias("value")
    left = rows.groupBy(*keys, *[F.col(c).alias(n) for c, n in zip(fixed, names, strict=True)], *own, value).agg(F.count("*").alias("_n0"))
    partners = df.where(_present(df, [*keys, *fixed1])).groupBy(*keys, *[F.col(c).alias(n) for c, n in zip(fixed1, others, strict=True)]).agg(F.count("*").alias("_n1"))
    itself = reduce_and([F.coalesce(F.col(f"_own_{c}") == F.col(n), F.lit(False)) for c, n in zip(fixed1, others, strict=True)])
    met = left.join(partners, keys).where(F.col("_n1") > itself.cast("int"))
    counts = met.groupBy(*names, *others, "value").agg(F.sum("_n0").alias("support"))
    total = F.sum("support").over(Window.partitionBy(*names, *others))
    rank = F.row_number().over(Window.partitionBy(*names, *others).orderBy(F.col("value").isNull(), F.desc("support"), "value"))
    found = counts.withColumn("rows0", total).withColumn("_r", rank).where("_r = 1 and value is not null").drop("_r")
    found = found.withColumn("confidence", F.round(F.col("support") / F.col("rows0"), 9))
    return found.where((F.col("support") >= support) & (F.col("confidence") >= confidence))


def recover_rules(df: DataFrame, relation: str, rules: list[Rule], support: int, confidence: float) -> DataFrame:
    """lhs, rhs, support, confidence, origin: all rules that the templates of rules found on a sample, constants
    freed, give on the full table (also those whose right-hand side is a constant), and beside them the rules of
    the sample that are not among these, with their measures there."""
    schema = "lhs array<string>, rhs string, support long, confidence double, origin string"
    out = df.sparkSession.createDataFrame([([str(p) for p in r.lhs], str(r.rhs), int(r.support), float(r.confidence), "sample") for r in rules], schema)
    free = lambda p: p if p.right else Predicate(p.left, p.op, constant=None)
    parts = None
    for keys, f0, f1, rhs in dict.fromkeys((*template(r)[:3], free(r.rhs)) for r in rules if any(p.is_constant for p in (*r.lhs, r.rhs)) and all(p.is_constant or p.left.column == p.right.column for p in r.lhs)):
        column = rhs.left.column
        if rhs.right:
            part, head = recover(df, keys, f0, f1, column, support, confidence), F.lit(str(rhs))
        else:
            part, head = recover_head(df, keys, f0, column, support, confidence, f1), F.concat(F.lit(f"{relation}.t0.{column} == "), F.col("value").cast("string"))
        text = lambda cs, v: [F.concat(F.lit(f"{relation}.t{v}.{c} == "), F.col(f"c{v}_{c}").cast("string")) for c in cs]
        lhs = F.array_sort(F.array(*[F.lit(f"{relation}.t0.{k} == {relation}.t1.{k}") for k in keys], *text(f0, 0), *text(f1, 1)))
        part = part.select(lhs.alias("lhs"), head.alias("rhs"), F.col("support").cast("long").alias("support"), "confidence", F.lit("recovered").alias("origin"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return out
    again = parts.select(F.col("lhs").alias("_lhs"), F.col("rhs").alias("_rhs"))
    return parts.unionByName(out.join(again, (F.array_sort("lhs") == F.col("_lhs")) & (F.col("rhs") == F.col("_rhs")), "left_anti"))
