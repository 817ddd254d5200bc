"""Group sizes against explicit pairs, on tables with nulls and blanks."""

import itertools
import random

import pytest
from ruleforge.operators import counting as C
from ruleforge.operators import joins as J
from ruleforge.operators import profile as R
from ruleforge.operators.predicates import Operand, Predicate
from ruleforge.operators.predicates import pair_predicates as P_pairs


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    pick = lambda xs: r.choice(xs)
    return [(i, pick(("a", "b", "c", "", None)), pick((1, 2, None)), pick(("x", "y", None, "")), pick((1, 2, 3))) for i in range(40)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, n int, y string, m int")


def value(row, c):
    v = row[("id", "k", "n", "y", "m").index(c)]
    return None if v == "" else v


def pairs(rows, lhs):
    def ok(p, a, b):
        x = value((a, b)[p.left.variable], p.left.column)
        z = p.constant if p.is_constant else value((a, b)[p.right.variable], p.right.column)
        return x is not None and z is not None and x == z

    return [(a, b) for a, b in itertools.permutations(rows, 2) if all(ok(p, a, b) for p in lhs)], ok


BODIES = [
    [C.equal("t", "k")], [C.equal("t", "k"), C.equal("t", "n")], [C.equal("t", "n"), C.is_value("t", "k", "a")], [C.equal("t", "n"), C.is_value("t", "k", "a"), C.is_value("t", "y", "x", 1)],
    [C.equal("t", "n", "t", "m")], [C.equal("t", "n", "t", "m"), C.is_value("t", "k", "b", 1)],
]


@pytest.mark.parametrize("lhs", BODIES, ids=lambda b: " & ".join(map(str, b)))
def test_supports_against_pairs(table, rows, lhs):
    heads = [C.equal("t", "y"), C.equal("t", "m"), C.is_value("t", "y", "x")]
    found, ok = pairs(rows, lhs)
    got = {r.rhs: r for r in C.with_confidence(C.count_rules(table, C.Body.of(lhs), heads)).collect()}
    for h in heads:
        g = got[str(h)]
        assert g.support_x == len(found)
        assert g.rows0 == len({a[0] for a, _ in found}) and g.rows1 == len({b[0] for _, b in found})
        want = len({a[0] for a, b in found if ok(h, a, b)}) if h.is_constant else sum(ok(h, a, b) for a, b in found)
        assert g.support == want
        base = int(g.rows0 if h.is_constant else g.support_x)
        assert g.confidence == pytest.approx(want / base if base else 0, abs=1e-8)


def test_cross_relation(spark, table, rows):
    other = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "oid long, v int")
    got = C.count_across(table, other, C.Body.of([C.equal("t", "n", "o", "v")]), [C.equal("t", "id", "o", "oid")]).first()
    want = [(r, o) for r in rows for o in ((1, 1), (2, 1), (3, 2), (4, None)) if r[2] is not None and r[2] == o[1]]
    assert got.support_x == len(want) and got.support == sum(r[0] == o[0] for r, o in want)


def test_anti_monotone(table):
    supp = lambda lhs: C.count_rules(table, C.Body.of(lhs), [C.equal("t", "m")]).first().support_x
    assert supp([C.equal("t", "k"), C.equal("t", "n")]) <= supp([C.equal("t", "k")])


def test_pairs_and_chains(spark, table, rows):
    lhs = [C.equal("t", "k"), C.is_value("t", "y", "x", 1)]
    found, _ = pairs(rows, lhs)
    assert sorted(map(tuple, J.tuple_pairs(table, table, lhs, "id", "id", True).collect())) == sorted((a[0], b[0]) for a, b in found)
    third = [Predicate(Operand("t", 1, "n"), "==", Operand("t", 2, "n"))]
    got = sorted(map(tuple, J.chain([table, table, table], ["id"] * 3, [C.equal("t", "k"), *third]).collect()))
    want = sorted({(a[0], b[0]) for a, b, c in itertools.permutations(rows, 3) if value(a, "k") and value(a, "k") == value(b, "k") and b[2] is not None and b[2] == c[2]})
    assert got == want


def test_evidence_against_pairs(table, rows):
    got = {r.mask: r.n for r in R.evidence(table, "id", ["k", "n", "y"], "k").collect()}
    want = {}
    for a, b in itertools.permutations(rows, 2):
        if value(a, "k") and value(a, "k") == value(b, "k"):
            mask = sum(1 << i for i, c in enumerate(("n", "y")) if value(a, c) is not None and value(a, c) == value(b, c))
            want[mask] = want.get(mask, 0) + 1
    assert got == want


def test_profiles(spark, table):
    types = dict(map(tuple, R.inferred_types(spark.createDataFrame([("1", "1.5", "x", ""), ("-2", "3", "4", None)], "a string, b string, c string, d string")).collect()))
    assert types["a"] == "LONG" and types["b"] == "NUMERIC" and types["c"] == "STRING"
    assert R.prefix(table, 0.0, "id").count() == 1 and [r.id for r in R.prefix(table, 0.2, "id").orderBy("id").collect()] == list(range(8))
    codes = [(r.value, r.code) for r in R.sorted_dictionary(table, "k").orderBy("code").collect()]
    assert codes == [("a", 1), ("b", 2), ("c", 3)]
    u = spark.createDataFrame([(1, "x"), (2, "y"), (None, "")], "m int, s string")
    found = {(r.left, r.a, r.right, r.b): (r.joinable, r.comparable) for r in R.column_pairs({"t": table.select("m", "y"), "u": u}, scored=[("t", "y", "u", "s")]).collect()}
    assert found["t", "m", "t", "m"] == (True, True) and found["t", "y", "t", "y"] == (True, False) and found["t", "y", "u", "s"][0] and ("t", "m", "u", "s") not in found
    keys = [("t", "m", "u", "m")]
    texts = {str(p) for p in P_pairs([("t", "m", "u", "m", True, True), ("t", "y", "u", "s", True, True)], {("t", "y"), ("u", "s")}, keys)}
    assert {"t.t0.m <= u.t1.m", "t.t0.y <> u.t1.s", "u.t0.m == t.t1.m"} <= texts and "t.t0.y < u.t1.s" not in texts


def test_a_level_in_one_pass(table):
    """Grouping sets give what each X gives by itself."""
    heads = [C.equal("t", "y"), C.equal("t", "m"), C.is_value("t", "y", "x")]
    sets = {tuple(lhs): heads for lhs in BODIES[:4]}
    got = C.count_level(table, sets)
    for x, lhs in enumerate(sets):
        for r in C.count_rules(table, C.Body.of(lhs), heads).collect():
            assert got[x, r.rhs] == {"support_x": r.support_x, "support": r.support, "rows0": r.rows0, "rows1": r.rows1}


def test_counts_beyond_longs(spark):
    """Sums stay decimals: three groups of 2**32 pairs' worth of rows are no overflow."""
    from pyspark.sql import functions as F

    big = spark.range(3).select(F.lit(3_100_000_000).cast(C.BIG).alias("n0"), F.lit(3_100_000_000).cast(C.BIG).alias("n1"))
    assert int(big.agg(F.sum(C._pairs(F.col("n0"), F.col("n1"), F.lit(0)))).first()[0]) == 3 * 3_100_000_000**2
    with pytest.raises(Exception):
        C.as_longs(big.agg(F.sum(C._pairs(F.col("n0"), F.col("n1"), F.lit(0))).alias("n"))).collect()


def test_join_graph_and_guard(spark):
    a, b, c = (spark.createDataFrame(rows, schema) for rows, schema in (([(1, 10), (2, 20)], "id long, b long"), ([(10, 100), (30, 300)], "id long, c long"), ([(100, "x"), (400, "y")], "id long, name string")))
    keys = [J.ForeignKey("a", "b", "b", "id"), J.ForeignKey("b", "c", "c", "id")]
    out = J.join_graph({"a": a, "b": b, "c": c}, keys, "a", {"a": "id", "b": "id", "c": "id"})
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 10, 100), (2, None, None), (None, 30, None), (None, None, 400)], key=str)
    same = spark.createDataFrame([(i, 1) for i in range(20)], "id long, v long")
    with pytest.raises(ValueError):
        J.most_selective({"t": same}, [C.equal("t", "v")], 0.1)
    assert J.affordable(10, 100) and not J.affordable(2000, 100)


def test_blocks_and_candidates(spark):
    rows = [(1, "alpha"), (1, "beta"), (2, "alpha"), (2, "beta"), (3, "alpha"), (3, "gamma"), (4, "xy"), (5, "xy")] + [(i, f"only{i}") for i in range(10, 40)]
    tokens = spark.createDataFrame(rows, "rid long, token string")
    assert sorted(map(tuple, J.block_index(tokens, "rid", "token").select("rid", "token").collect())) == sorted((r, t) for r, t in rows if t in ("alpha", "beta"))
    assert [(r.a, r.b, r.shared) for r in J.candidate_pairs(tokens, "rid", "token", 0.5).collect()] == [(1, 2, 2)]


def test_key_paths():
    keys = [J.ForeignKey("a", "x", "b", "x"), J.ForeignKey("b", "y", "c", "y")]
    assert set(J.key_paths(keys, 2)) == {("a",), ("b",), ("c",), ("a", "b"), ("b", "c")} and ("a", "b", "c") in J.key_paths(keys, 3)


def test_prefix_over_range_partitions(spark):
    """Rows and the counts of their partitions come from one split, whatever columns each needs."""
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"), F.col("id").alias("other"), (F.col("id") % 1000 / 8).alias("x"))
    for ratio in (0.1, 0.37, 0.9):
        kept = R.prefix(rows, ratio, "k").agg(F.count("*"), F.max("k"), F.countDistinct("k", "other")).first()
        assert tuple(kept) == (int(ratio * 60_000), int(ratio * 60_000) - 1, int(ratio * 60_000)), ratio


def test_order_support_over_range_partitions(spark):
    from pyspark.sql import functions as F

    wide = spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("a"))
    some = spark.range(40_000).where("id % 13 = 0").select(F.col("id").alias("b"))
    got = {r.op: int(r.n) for r in C.order_support(wide, "a", some, "b").collect()}
    below = sum(range(0, 40_000, 13))
    n = 40_000 * len(range(0, 40_000, 13))
    same = len(range(0, 40_000, 13))
    assert got == {"==": same, "<>": n - same, "<": below, "<=": below + same, ">": n - below - same, ">=": n - below}
