"""Rules: text, SQL, comparison of rule sets, violations."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counting import BIG, Body, _meets, _present
from ..operators.predicates import Predicate, parse


@dataclass(frozen=True)
class Rule:
    lhs: tuple[Predicate, ...]
    rhs: Predicate
    support: int = 0
    confidence: float = 0.0
    score: float = 0.0
    violations: int = field(default=0, compare=False)

    @staticmethod
    def of(lhs: Iterable[Predicate], rhs: Predicate, **measures) -> Rule:
        return Rule(tuple(sorted(lhs, key=str)), rhs, **measures)

    @property
    def tables(self) -> list[str]:
        by_variable: dict[int, str] = {}
        for p in (*self.lhs, self.rhs):
            for o in (p.left, p.right):
                if o:
                    by_variable[o.variable] = o.relation
        return [by_variable[v] for v in sorted(by_variable)]

    def __str__(self) -> str:
        body = "  ".join(map(str, self.lhs))
        return f"Rule : [REE: {' ^ '.join(self.tables)} ^ {body} -> {self.rhs}], supp: {self.support}, conf:{self.confidence:.9g}"

    def check_sql(self, tid: str) -> str:
        """SQL for the pairs that satisfy the left-hand side but not the right."""
        return f"SELECT {self._ids(tid)} FROM {self._from()} WHERE {self._where(tid)} AND NOT coalesce({_sql(self.rhs)}, false)"

    def correct_sql(self, tid: str) -> str:
        """SQL for those pairs with the value that the right-hand side asks for."""
        p = self.rhs
        wanted = _literal(p.constant) if p.is_constant else f"t{p.right.variable}.{p.right.column}"
        return f"SELECT {self._ids(tid)}, t{p.left.variable}.{p.left.column} AS found, {wanted} AS wanted FROM {self._from()} WHERE {self._where(tid)} AND NOT coalesce({_sql(p)}, false)"

    def _ids(self, tid: str) -> str:
        return ", ".join(f"t{i}.{tid} AS tid{i}" for i in range(len(self.tables)))

    def _from(self) -> str:
        return ", ".join(f"{t} t{i}" for i, t in enumerate(self.tables))

    def _where(self, tid: str) -> str:
        parts = [_sql(p) for p in self.lhs]
        names = self.tables
        parts += [f"t{i}.{tid} <> t{j}.{tid}" for j in range(len(names)) for i in range(j) if names[i] == names[j]]
        return " AND ".join(parts)


def _literal(v) -> str:
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _sql(p: Predicate) -> str:
    op = "=" if p.op == "==" else p.op
    a = f"t{p.left.variable}.{p.left.column}"
    if p.is_scored:
        return f"similar('{p.model}', {a}, t{p.right.variable}.{p.right.column}) >= {p.threshold:g}"
    return f"{a} {op} {_literal(p.constant) if p.is_constant else f't{p.right.variable}.{p.right.column}'}"


_LINE = re.compile(r"Rule : \[REE: (.*) -> (.*)\], supp: (\d+), conf:([0-9.eE+-]+)")


def parse_rule(line: str) -> Rule | None:
    """A rule from its text; None if the line is none."""
    if not (m := _LINE.match(line.strip())):
        return None
    body = m[1].rsplit(" ^ ", 1)[-1]
    return Rule.of([parse(p) for p in re.split(r"\s{2,}", body) if p], parse(m[2]), support=int(m[3]), confidence=float(m[4]))


RULES_SCHEMA = "rule string, lhs array<string>, rhs string, level int, support long, confidence double, score double"


def as_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(str(r), [str(p) for p in r.lhs], str(r.rhs), len(r.lhs), int(r.support), float(round(r.confidence, 9)), float(round(r.score, 9))) for r in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def uncovered(rules: DataFrame, others: DataFrame) -> DataFrame:
    """Rules for which no other rule has the same right-hand side and a left-hand side within theirs."""
    o = others.select(F.col("rhs").alias("_rhs"), F.col("lhs").alias("_lhs"))
    return rules.join(o, (F.col("rhs") == F.col("_rhs")) & (F.size(F.array_except("_lhs", "lhs")) == 0), "left_anti")


def compare(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many rules of each set the other covers, and the shares (precision, recall)."""
    row = lambda a, b, n: a.agg(F.count("*").alias("n")).join(F.broadcast(uncovered(a, b).agg(F.count("*").alias("missed")))).select(F.lit(n).alias("measure"), "n", "missed", F.round(1 - F.try_divide("missed", "n"), 9).alias("share"))  # noqa: E731  one row each
    return row(found, wanted, "precision").unionByName(row(wanted, found, "recall"))


# ---------------------------------------------------------------- violations


def violating_pairs(df: DataFrame, lhs: list[Predicate], rhs: Predicate, tid: str) -> DataFrame:
    """Ordered pairs (tid0, tid1) that satisfy lhs but not rhs.  Only groups that hold more than one value
    of the right-hand side are joined."""
    body = Body.of(lhs)
    keys = [a for a, _ in body.keys]
    y = rhs.left.column
    rows = df.where(_present(df, keys))
    mixed = rows.groupBy(*keys).agg(F.min(y).alias("_a"), F.max(y).alias("_b"), F.count(F.when(_present(df, [y]), 1)).alias("_n"), F.count("*").alias("_m")).where("_a <> _b or _n < _m or _a is null")
    own = rows.join(mixed.select(*keys), keys, "left_semi")
    side = lambda v: own.where(_meets(df, body, v)).select(*keys, F.col(tid).alias(f"tid{v}"), F.when(_present(df, [y]), F.col(y)).alias(f"y{v}"))
    pairs = side(0).join(side(1), keys).where("tid0 <> tid1")
    return pairs.where(~F.coalesce(F.col("y0") == F.col("y1"), F.lit(False))).select("tid0", "tid1")


def violating_groups(df: DataFrame, keys: list[str], rhs: str) -> DataFrame:
    """Groups of equal keys with several values of rhs: the keys, rows, values, and pairs in conflict.  Sizes
    come from two aggregates, so a hot group costs no pairs."""
    rows = df.where(_present(df, [*keys, rhs]))
    by_value = rows.groupBy(*keys, rhs).agg(F.count("*").alias("_size"))
    n, same = F.sum("_size").cast(BIG), F.sum(F.col("_size").cast(BIG) * (F.col("_size") - 1))
    return by_value.groupBy(*keys).agg(n.alias("n_rows"), F.count("*").alias("n_values"), (n * (n - 1) - same).cast(BIG).alias("conflicts")).where("n_values > 1")


def constant_violations(df: DataFrame, lhs: list[Predicate], rhs: Predicate, tid: str) -> DataFrame:
    """Rows t0 with a partner under lhs whose value is not the constant of rhs."""
    body = Body.of(lhs)
    keys = [a for a, _ in body.keys]
    rows = df.where(_present(df, keys))
    partners = rows.where(_meets(df, body, 1)).groupBy(*keys).agg(F.count("*").alias("_n"))
    own = rows.where(_meets(df, body, 0)).withColumn("_self", F.when(_meets(df, body, 1), 1).otherwise(0))
    return own.join(partners, keys).where(F.col("_n") > F.col("_self")).where(~F.coalesce(F.col(rhs.left.column) == rhs.constant, F.lit(False))).select(tid)
