"""Predicates over tuple variables, their text form, their algebra, and how they become columns.

A predicate is ``rel.t0.col == rel.t1.col`` (between tuples), ``rel.t0.col == constant``, or a scored one,
``similar('model', rel.t0.col, rel.t1.col, 0.9)``.  Null and blank values satisfy no predicate.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("==", "<>", "<", "<=", ">", ">=")
#: Algebra of the operators: what each implies, its negation, and itself with sides exchanged.
IMPLIES = {"==": ("==", "<=", ">="), "<>": ("<>",), "<": ("<", "<=", "<>"), "<=": ("<=",), ">": (">", ">=", "<>"), ">=": (">=",)}
INVERSE = {"==": "<>", "<>": "==", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
SWAPPED = {"==": "==", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: Two operators on the same operands that together mean a third.
BOTH = {frozenset(("<>", "<=")): "<", frozenset(("<>", ">=")): ">", frozenset(("<=", ">=")): "=="}
CONTRADICT = {frozenset(p) for p in (("==", "<>"), ("==", "<"), ("==", ">"), ("<", ">"), ("<", ">="), (">", "<="))}


@dataclass(frozen=True, order=True)
class Operand:
    relation: str
    variable: int
    column: str

    def __str__(self) -> str:
        return f"{self.relation}.t{self.variable}.{self.column}"

    def renamed(self, variables: dict[int, int]) -> Operand:
        return replace(self, variable=variables.get(self.variable, self.variable))


@dataclass(frozen=True)
class Predicate:
    left: Operand
    op: str = "=="
    right: Operand | None = None
    constant: object = None
    model: str | None = None
    threshold: float | None = None

    @property
    def is_constant(self) -> bool:
        return self.right is None

    @property
    def is_scored(self) -> bool:
        return self.model is not None

    @property
    def variables(self) -> frozenset[int]:
        return frozenset(o.variable for o in (self.left, self.right) if o)

    @property
    def relations(self) -> frozenset[str]:
        return frozenset(o.relation for o in (self.left, self.right) if o)

    def __str__(self) -> str:
        if self.is_scored:
            return f"similar('{self.model}', {self.left}, {self.right}, {self.threshold:g})"
        return f"{self.left} {self.op} {self.constant if self.is_constant else self.right}"

    def inverse(self) -> Predicate:
        return replace(self, op=INVERSE[self.op])

    def symmetric(self) -> Predicate:
        """The same statement with its sides exchanged."""
        return self if self.is_constant else replace(self, left=self.right, right=self.left, op=SWAPPED[self.op])

    def implications(self) -> list[Predicate]:
        return [self] if self.is_scored else [replace(self, op=o) for o in IMPLIES[self.op]]

    def at(self, *variables: int) -> Predicate:
        """The predicate on other tuple variables: its own, in order, become the given ones."""
        own = dict(zip(sorted(self.variables), variables, strict=False))
        return replace(self, left=self.left.renamed(own), right=self.right and self.right.renamed(own))

    def mirrored(self) -> Predicate:
        """t0 and t1 exchanged, and put back into canonical order."""
        return self.at(*({0: 1, 1: 0}.get(v, v) for v in sorted(self.variables))).canonical()

    def canonical(self) -> Predicate:
        return self.symmetric() if self.right and self.right.variable < self.left.variable else self


_OPERAND = r"(\w+)\.t(\d+)\.(\w+)"
_SCORED = re.compile(rf"(?:similar\(\s*'([^']*)'|ML_(\w+)\()\s*,?\s*{_OPERAND}\s*,\s*{_OPERAND}\s*(?:,\s*([0-9.]+)\s*)?\)")
_PLAIN = re.compile(rf"{_OPERAND}\s*(==|<>|<=|>=|<|>|=)\s*(.*)")


def parse(text: str) -> Predicate:
    """The inverse of str(); `=` and ``ML_name(a , b)`` are understood too."""
    text = text.strip()
    if m := _SCORED.fullmatch(text):
        left, right = Operand(m[3], int(m[4]), m[5]), Operand(m[6], int(m[7]), m[8])
        return Predicate(left, "==", right, model=m[1] or m[2], threshold=float(m[9] or 0))
    if not (m := _PLAIN.fullmatch(text)):
        raise ValueError(f"no predicate: {text!r}")
    left, op = Operand(m[1], int(m[2]), m[3]), "==" if m[4] == "=" else m[4]
    if n := re.fullmatch(_OPERAND, m[5].strip()):
        return Predicate(left, op, Operand(n[1], int(n[2]), n[3]))
    return Predicate(left, op, constant=m[5].strip().strip("'"))


# ---------------------------------------------------------------- as columns


def present(c: Column, is_text: bool = True) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (c != "") if is_text else c.isNotNull()


def compare(a: Column, op: str, b: Column) -> Column:
    return {"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def holds(p: Predicate, text_columns: Iterable[str] = (), prefix: str = "t") -> Column:
    """The predicate over aliases t0, t1, ...; false, not null, where a value is missing."""
    text = set(text_columns)
    side = lambda o: F.col(f"{prefix}{o.variable}.{o.column}")
    a = side(p.left)
    b = F.lit(p.constant) if p.is_constant else side(p.right)
    ok = present(a, p.left.column in text)
    if p.right:
        ok = ok & present(b, p.right.column in text)
    return F.coalesce(ok & compare(a, p.op, b), F.lit(False))


def indicator(p: Predicate, text_columns: Iterable[str] = (), prefix: str = "t") -> Column:
    """1 where the predicate holds, else 0."""
    return F.when(holds(p, text_columns, prefix), 1).otherwise(0)


# ---------------------------------------------------------------- reasoning over sets


def closure(predicates: Iterable[Predicate]) -> tuple[frozenset[Predicate], bool]:
    """Everything that follows by implication, symmetry, combination and transitivity, and whether the
    set is trivial (it contradicts itself)."""
    known: set[Predicate] = set()
    new = {q for p in predicates for q in p.implications()}
    while new:
        known |= new
        found: set[Predicate] = {p.symmetric() for p in new if not p.is_scored}
        by_operands: dict[tuple, dict[str, Predicate]] = {}
        for p in known:
            if not p.is_scored:
                by_operands.setdefault((p.left, p.right, p.constant), {})[p.op] = p
        for ops in by_operands.values():
            for a, b in itertools.combinations(ops, 2):
                if frozenset((a, b)) in CONTRADICT:
                    return frozenset(known), True
                if (op := BOTH.get(frozenset((a, b)))) is not None:
                    found |= set(replace(ops[a], op=op).implications())
        pairs = [p for p in known if p.right and not p.is_scored]
        for p, q in itertools.product(pairs, [q for q in known if not q.is_scored]):
            if p.right == q.left and p.left != q.right:
                op = q.op if p.op == "==" else p.op if q.op in ("==", p.op) and p.op != "<>" else None
                if op is None and {p.op, q.op} in ({"<", "<="}, {">", ">="}):
                    op = "<" if "<" in (p.op, q.op) else ">"
                if op is not None:
                    found |= set(Predicate(p.left, op, q.right, q.constant).implications())
        new = found - known
    return frozenset(known), False


class RuleIndex:
    """Rules by right-hand side, for tests whether a rule follows from a more general one.

    Left-hand sides are bit masks over the predicates seen, so a test is a scan of integers.
    """

    def __init__(self):
        self.bits: dict[Predicate, int] = {}
        self.rules: dict[Predicate, list[int]] = {}

    def mask(self, predicates: Iterable[Predicate]) -> int:
        out = 0
        for p in predicates:
            out |= 1 << self.bits.setdefault(p.canonical(), len(self.bits))
        return out

    def add(self, lhs: Iterable[Predicate], rhs: Predicate) -> None:
        self.rules.setdefault(rhs.canonical(), []).append(self.mask(lhs))

    def implied(self, lhs: Iterable[Predicate], rhs: Predicate) -> bool:
        """Whether a stored rule with this right-hand side (or its t0-t1 mirror) has a left-hand side
        inside of the closure of lhs."""
        all_of, trivial = closure(lhs)
        if trivial:
            return True
        own, mirror = self.mask(all_of), self.mask(p.mirrored() for p in all_of)
        rhs = rhs.canonical()
        return any(m & ~own == 0 for m in self.rules.get(rhs, ())) or any(m & ~mirror == 0 for m in self.rules.get(rhs.mirrored(), ()))


# ---------------------------------------------------------------- spaces of predicates


def column_predicates(relation: str, columns: dict[str, str], other: str | None = None, pairs: Iterable[tuple[str, str]] = (), ordered: bool = False) -> list[Predicate]:
    """Predicates between two tuples: each column with itself and the given pairs of columns.  columns
    names the kind (text or number); order comparisons are for numbers only."""
    found = []
    for a, b in [(c, c) for c in columns] + [tuple(p) for p in pairs]:
        ops = OPERATORS if ordered and columns.get(a) == "number" else OPERATORS[:2]
        found += [Predicate(Operand(relation, 0, a), op, Operand(other or relation, 1, b)) for op in ops]
    return found


def pair_predicates(pairs: Iterable[tuple[str, str, str, str, bool, bool]], text_columns: set[tuple[str, str]], keys: Iterable[tuple[str, str, str, str]] = ()) -> list[Predicate]:
    """Predicates of t0 and t1 from column pairs (left, a, right, b, joinable, comparable): == and <> where columns
    are joinable, order comparisons for comparable numbers, and an equality each way for every foreign key."""
    found = []
    for left, a, right, b, joinable, comparable in pairs:
        ops = OPERATORS[:2] if joinable else ()
        if comparable and not {(left, a), (right, b)} & text_columns:
            ops = (*ops, *OPERATORS[2:])
        found += [Predicate(Operand(left, 0, a), op, Operand(right, 1, b)) for op in ops]
    for left, a, right, b in keys:
        found += [Predicate(Operand(left, 0, a), "==", Operand(right, 1, b)), Predicate(Operand(right, 0, b), "==", Operand(left, 1, a))]
    return list(dict.fromkeys(found))


def constant_predicates(relation: str, constants: dict[str, list], ordered: bool = False) -> list[Predicate]:
    """== on t0 and t1 for every constant; <= and >= on t0 if ordered."""
    found = []
    for c, values in constants.items():
        for v in values:
            found += [Predicate(Operand(relation, t, c), "==", constant=v) for t in (0, 1)]
            if ordered:
                found += [Predicate(Operand(relation, 0, c), op, constant=v) for op in ("<=", ">=")]
    return found


def on_all_variables(predicates: Iterable[Predicate], n: int) -> list[Predicate]:
    """Each predicate on every tuple variable, or pair of them in order, of n."""
    out = []
    for p in predicates:
        out += [p.at(*vs) for vs in itertools.combinations(range(n), len(p.variables))]
    return list(dict.fromkeys(out))


def right_hand_sides(predicates: Iterable[Predicate]) -> list[Predicate]:
    return [p for p in predicates if not p.is_constant]


def relevant(predicates: list[Predicate], rhs: list[Predicate], variables: int = 2) -> list[Predicate]:
    """Without predicates over relations of no right-hand side, where no longer chain could reach them."""
    if variables > 2 or any(p.is_constant for p in rhs):
        return predicates
    inside = frozenset().union(*(p.relations for p in rhs)) if rhs else frozenset()
    return [p for p in predicates if p.relations <= inside]


def grouped(predicates: Iterable[Predicate], kinds: dict[str, str]) -> dict[tuple[str, str], list[Predicate]]:
    """By kind of column (number, text) and by shape (constant, single column, cross column)."""
    out: dict[tuple[str, str], list[Predicate]] = {}
    for p in predicates:
        shape = "constant" if p.is_constant else "single" if p.left.column == p.right.column and p.left.relation == p.right.relation else "cross"
        out.setdefault((kinds.get(p.left.column, "text"), shape), []).append(p)
    return out


def correlated(predicates: Iterable[Predicate], rhs: Predicate, listed: set[tuple[str, str]]) -> list[Predicate]:
    """Those listed as correlated with the right-hand side."""
    return [p for p in predicates if (str(p), str(rhs)) in listed]


def refined(evidence: dict[frozenset[Predicate], int]) -> dict[frozenset[Predicate], int]:
    """Sets without an equality between tuples go; the others keep the predicates over the relations of
    their first equality; equal results are added up."""
    out: dict[frozenset[Predicate], int] = {}
    for found, n in evidence.items():
        equal = sorted((p for p in found if p.op == "==" and p.right), key=str)
        if equal:
            kept = frozenset(p for p in found if p.relations <= equal[0].relations)
            out[kept] = out.get(kept, 0) + n
    return out
