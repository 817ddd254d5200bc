"""Predicates, rules, discovery and recovery."""

import itertools
import random

import pytest
from ruleforge.operators import counting as C
from ruleforge.operators import predicates as P
from ruleforge.operators import sampling as A
from ruleforge.plans import discovery as D
from ruleforge.plans import models as N
from ruleforge.plans import rules as U
from ruleforge.sources import files

COLUMNS = ["k", "n", "y"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(i, (k := r.choice("abc")), (n := r.choice((1, 2))), {"a": "x", "b": "y", "c": "z"}[k] if r.random() < 0.9 else "w") for i in range(30)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, n int, y string")


def brute(rows, support, confidence, levels, constants):
    """All minimal rules over explicit pairs."""
    at = {"k": 1, "n": 2, "y": 3}
    pair_preds = [C.equal("t", c) for c in COLUMNS]
    fixed = [C.is_value("t", c, v, side) for c, vs in constants.items() for v in vs for side in (0, 1)]
    holds = lambda p, a, b: (a, b)[p.left.variable][at[p.left.column]] == (p.constant if p.is_constant else b[at[p.right.column]])
    found = {}
    for size in range(1, levels + 1):
        for lhs in itertools.combinations(pair_preds + fixed, size):
            if not any(p.right for p in lhs) or not D.compatible(frozenset(lhs)):
                continue
            ok = [(a, b) for a, b in itertools.permutations(rows, 2) if all(holds(p, a, b) for p in lhs)]
            for rhs in pair_preds:
                if rhs in lhs or any(set(x) < set(lhs) for x in found.get(rhs, ())):
                    continue
                n = sum(holds(rhs, a, b) for a, b in ok)
                if len(ok) >= support and n >= support and n / len(ok) >= confidence:
                    found.setdefault(rhs, []).append(lhs)
    return {(frozenset(x), r) for r, xs in found.items() for x in xs}


@pytest.mark.parametrize("support, confidence", [(1, 0.8), (20, 0.5), (30, 0.9)])
def test_discovery_against_brute_force(table, rows, support, confidence):
    constants = {"y": ["x", "w"]}
    got = D.discover(table, "t", COLUMNS, constants=constants, support=support, confidence=confidence, levels=3)
    assert {(frozenset(r.lhs), r.rhs) for r in got} == brute(rows, support, confidence, 3, constants)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_top_rules_are_the_first(table):
    every = D.discover(table, "t", COLUMNS, support=1, confidence=0.3, levels=2)
    assert [str(r) for r in D.discover(table, "t", COLUMNS, support=1, confidence=0.3, levels=2, top=3)] == [str(r) for r in every[:3]]


def test_constant_heads(table, rows):
    got = D.discover(table, "t", COLUMNS, constants={"y": ["x"]}, support=1, confidence=0.2, levels=2, constant_rhs=True)
    r = next(r for r in got if r.rhs.is_constant and len(r.lhs) == 1 and r.lhs[0].left.column == "n")
    with_partner = [a for a in rows if sum(a[2] == b[2] for b in rows) > 1]
    assert r.confidence == pytest.approx(sum(a[3] == "x" for a in with_partner) / len(with_partner), abs=1e-8)


def test_filters_of_the_search(table):
    only = {("t.t0.k == t.t1.k", "t.t0.y == t.t1.y")}
    got = D.discover(table, "t", COLUMNS, support=1, confidence=0.1, levels=2, listed=only)
    assert {(tuple(map(str, r.lhs)), str(r.rhs)) for r in got} <= {(("t.t0.k == t.t1.k",), "t.t0.y == t.t1.y")}
    assert D.discover(table, "t", COLUMNS, support=1, confidence=0.1, levels=2, prune=lambda lhs, rhs: True) == []


@pytest.mark.parametrize("fixed0, fixed1", [(["y"], []), ([], ["y"]), (["y"], ["y"]), (["y"], ["k"])])
def test_recovery_against_pairs(table, rows, fixed0, fixed1):
    at = {"k": 1, "n": 2, "y": 3}
    got = {tuple(r[c] for c in [f"c0_{x}" for x in fixed0] + [f"c1_{x}" for x in fixed1]): (r.support_x, r.support) for r in D.recover(table, ["n"], fixed0, fixed1, "k", 1, 0.0).collect()}
    want = {}
    for a, b in itertools.permutations(rows, 2):
        if a[2] == b[2]:
            key = tuple(a[at[c]] for c in fixed0) + tuple(b[at[c]] for c in fixed1)
            s, n = want.get(key, (0, 0))
            want[key] = (s + 1, n + (a[1] == b[1]))
    assert got == {k: v for k, v in want.items() if v[1] >= 1}


def test_recovered_rules_hold_on_all_rows(table):
    same = C.equal("t", "n")
    with_constants = [U.Rule.of([same, C.is_value("t", "y", "x")], C.equal("t", "k")), U.Rule.of([same, C.is_value("t", "y", "x"), C.is_value("t", "k", "a", 1)], C.equal("t", "y"))]
    assert D.recover_rules(table, "t", [], 1, 0.5).collect() == []
    plain = U.Rule.of([same], C.equal("t", "k"), support=7, confidence=0.5)
    found = D.recover_rules(table, "t", [*with_constants, plain], 1, 0.2).collect()
    assert len(found) > 3 and [(r.lhs, r.support) for r in found if r.origin == "sample"] == [(["t.t0.n == t.t1.n"], 7)]
    for r in (r for r in found if r.origin == "recovered"):
        lhs = [P.parse(x) for x in r.lhs]
        lhs = [C.is_value("t", p.left.column, int(p.constant), p.left.variable) if p.is_constant and p.left.column == "n" else p for p in lhs]
        assert C.count_rules(table, C.Body.of(lhs), [P.parse(r.rhs)]).first().support == r.support


@pytest.mark.parametrize("fixed0, fixed1", [(["y"], []), ([], ["y"]), (["k"], ["k"])])
def test_recovered_constant_heads_against_pairs(table, rows, fixed0, fixed1):
    at = {"k": 1, "n": 2, "y": 3}
    head = "k" if "y" in fixed0 + fixed1 else "y"
    names = [f"c0_{x}" for x in fixed0] + [f"c1_{x}" for x in fixed1]
    got = {tuple(r[c] for c in names): (r.value, r.support, r.rows0) for r in D.recover_head(table, ["n"], fixed0, head, 1, 0.0, fixed1).collect()}
    met = {}
    for a, b in itertools.permutations(rows, 2):
        if a[2] == b[2]:
            met.setdefault(tuple(a[at[c]] for c in fixed0) + tuple(b[at[c]] for c in fixed1), set()).add(a)
    for key, own in met.items():
        counts = {}
        for a in own:
            counts[a[at[head]]] = counts.get(a[at[head]], 0) + 1
        value = min(counts, key=lambda v: (-counts[v], v))
        assert got[key] == (value, counts[value], len(own))
    assert set(got) == set(met)
    rule = U.Rule.of([C.equal("t", "n"), *[C.is_value("t", c, "x", 0) for c in fixed0], *[C.is_value("t", c, "x", 1) for c in fixed1]], C.is_value("t", head, "a"))
    assert D.recover_rules(table, "t", [rule], 1, 0.0).where("origin = 'recovered'").count() == len(got)


def holds(p, tuples, at, scored):
    if p.is_scored:
        return (tuples[0][0], tuples[1][0]) in scored
    value = lambda o: tuples[o.variable][at[o.relation][o.column]]
    a, b = value(p.left), p.constant if p.is_constant else value(p.right)
    return a not in (None, "") and b not in (None, "") and {"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]


def brute_counts(data, at, lhs, rhs, scored):
    """support_x, support, rows0 over explicit tuples of all variables."""
    relation = {o.variable: o.relation for p in lhs for o in (p.left, p.right) if o}
    pairs, hits, rows0, rows_hit = set(), set(), set(), set()
    for tuples in itertools.product(*[data[relation[v]] for v in range(len(relation))]):
        if any(relation[i] == relation[j] and tuples[i][0] == tuples[j][0] for i in range(len(tuples)) for j in range(i)):
            continue
        if all(holds(p, tuples, at, scored) for p in lhs):
            pairs.add((tuples[0][0], tuples[1][0]))
            rows0.add(tuples[0][0])
            if holds(rhs, tuples, at, scored):
                hits.add((tuples[0][0], tuples[1][0]))
                rows_hit.add(tuples[0][0])
    return len(pairs), len(rows_hit) if rhs.is_constant else len(hits), len(rows0)


def test_search_over_tables_operators_and_variables(spark):
    """Two tables, order comparisons, a scored predicate, constants and a third variable: every counted candidate
    has the counts of explicit tuples, every rule is valid and minimal, and nothing valid is missed."""
    r = random.Random(6)
    data = {
        "a": [(i, r.choice("xyz"), r.choice((1, 2, 3, None)), r.choice(("p", "q", ""))) for i in range(9)],
        "b": [(i, r.choice("xyz"), r.choice((1, 2, 3)), r.choice("pq")) for i in range(7)],
    }
    at = {"a": {"id": 0, "k": 1, "n": 2, "s": 3}, "b": {"id": 0, "k": 1, "n": 2, "s": 3}}
    tables = {t: spark.createDataFrame(rows, "id long, k string, n int, s string") for t, rows in data.items()}
    scored = {(i, j) for i in range(9) for j in range(7) if r.random() < 0.5}
    near = P.parse("similar('m', a.t0.s, b.t1.s, 0.5)")
    source = D.Source(tables, {"a": "id", "b": "id"}, {str(near): spark.createDataFrame(sorted(scored), "tid0 long, tid1 long")})
    pairs = [C.equal("a", "k"), C.equal("a", "s"), C.equal("a", "k", "b", "k"), C.equal("a", "s", "b", "s"), C.equal("a", "n", "b", "n"), P.parse("a.t0.n <= b.t1.n"), P.parse("a.t0.n < a.t1.n"), near]
    fixed = [C.is_value("a", "s", "p"), C.is_value("b", "s", "q", 1)]
    heads = [C.equal("a", "k"), C.equal("a", "k", "b", "k"), C.equal("a", "s", "b", "s"), C.is_value("a", "k", "x")]
    found = D.mine(source, pairs, fixed, heads, support=2, confidence=0.4, levels=2, variables=3)
    kinds = set()
    for lhs, rhs, c in found.counted:
        assert (c["support_x"] if not rhs.is_constant else None, c["support"], c["rows0"] if rhs.is_constant else None) == tuple(
            v if k != (0 if rhs.is_constant else 2) else None for k, v in enumerate(brute_counts(data, at, sorted(lhs, key=str), rhs, scored))
        ), (lhs, rhs)
        kinds |= {"three" if len({v for p in lhs for v in p.variables}) == 3 else "", "scored" if near in lhs else "", "order" if any(p.op != "==" for p in lhs) else "", "cross" if any(len(p.relations) == 2 for p in lhs) else "", "constant" if rhs.is_constant else ""}
    assert kinds >= {"three", "scored", "order", "cross", "constant"}
    valid = {(frozenset(x.lhs), x.rhs) for x in found.rules}
    assert valid and not any(y == q and x < p for x, y in valid for p, q in valid)
    n_rows = max(map(len, data.values()))
    for size in (1, 2):
        for lhs in map(frozenset, itertools.combinations(pairs + fixed, size)):
            for rhs in heads:
                if D.compatible(lhs) and D.countable(lhs, rhs):
                    x, n, rows0 = brute_counts(data, at, lhs, rhs, scored)
                    total = n * (n_rows if rhs.is_constant else 1)
                    base = rows0 if rhs.is_constant else x
                    if x >= 2 and total >= 2 and n / base >= 0.4:
                        assert any(p <= lhs and q == rhs for p, q in valid), (lhs, rhs)


def test_pruning_by_the_bound_changes_no_result(table):
    pairs = [C.equal("t", c) for c in COLUMNS]
    fixed = P.constant_predicates("t", {"y": ["x", "y", "z", "w"], "k": ["a", "b"]})
    run = lambda bounded: D.mine(D.Source({"t": table}, {}), pairs, fixed, pairs, 1, 0.45, 3, 2, bounded=bounded, weights=(0.0, 0.1, 0.0, 5.0, 0.0))
    some, every = run(True), run(False)
    assert [str(r) for r in some.rules] == [str(r) for r in every.rules]
    assert sum(x["by_bound"] for x in some.log) > 0 and len(some.counted) < len(every.counted)


def test_a_level_is_one_job(table):
    pairs = [C.equal("t", c) for c in COLUMNS]
    found = D.mine(D.Source({"t": table}, {}), pairs, P.constant_predicates("t", {"y": ["x", "w"]}), pairs, 1, 0.99, 3)
    assert [x["jobs"] for x in found.log] == [1] * len(found.log) and max(x["candidates"] for x in found.log) > 10


def test_online_filter_prunes_within_the_search(table):
    pairs = [C.equal("t", c) for c in COLUMNS]
    fixed = P.constant_predicates("t", {"y": ["x", "w"], "k": ["a", "b", "c"]})
    online = N.OnlineFilter(N.Vocabulary(pairs + fixed), 60, 0.8)
    found = D.mine(D.Source({"t": table}, {}), pairs, fixed, pairs, 60, 0.95, 3, learn=online.learn, prune=online.prune)
    assert online.trained and sum(x["by_filter"] for x in found.log) > 0
    assert {str(r) for r in found.rules} <= {str(r) for r in D.mine(D.Source({"t": table}, {}), pairs, fixed, pairs, 60, 0.95, 3).rules}


def test_templates_drop_covered_candidates():
    k, y, head = C.equal("t", "k"), C.is_value("t", "y", "x"), C.equal("t", "n")
    valid = {head: [frozenset([k, y])]}
    assert D.by_template(frozenset([k, C.is_value("t", "y", "other")]), head, valid) and not D.by_template(frozenset([k, C.is_value("t", "n", 1)]), head, valid)
    assert not D.by_template(frozenset([k]), C.equal("t", "y"), valid) and not D.by_template(frozenset([head, y]), head, {head: [frozenset([k])]})


def test_trainers():
    words = N.Vocabulary([C.equal("t", c) for c in COLUMNS])
    a, b, c = words.predicates
    net = N.train_filter(words, [([a], c, "FAILURE"), ([b], c, "SUCCESS"), ([a, b], c, "FAILURE"), ([b], a, "SUCCESS")])
    prune = N.expansion_filter(net, words)
    assert prune([a], c) and not prune([b], c)
    r = N.np.random.default_rng(1)
    tokens = {w: r.normal(size=4) for p in words.predicates for w in N.EmbeddingScore.words_of(p)}
    score = N.EmbeddingScore(tokens, r.normal(size=(4, 4)), r.normal(size=8))
    wanted = [(([a], c), ([b], c)), (([a], b), ([c], b))]
    score.fit(wanted)
    assert all(score(*x) > score(*y) for x, y in wanted)


def test_text_round_trips(table):
    for text in ("t.t0.a == t.t1.b", "t.t0.a <= 5", "similar('cosine', t.t0.a, u.t1.b, 0.9)"):
        assert str(P.parse(text)) == text
    assert P.parse("ML_ditto(a.t0.x , b.t1.y)").model == "ditto"
    with pytest.raises(ValueError):
        P.parse("nonsense")
    for r in D.discover(table, "t", COLUMNS, support=1, confidence=0.5, levels=2):
        back = U.parse_rule(str(r))
        assert (back.lhs, back.rhs, back.support) == (r.lhs, r.rhs, r.support)
    assert U.parse_rule("something else") is None


def test_algebra():
    p = P.parse("t.t0.a < t.t1.a")
    assert p.inverse().op == ">=" and p.symmetric() == P.parse("t.t1.a > t.t0.a") and {q.op for q in p.implications()} == {"<", "<=", "<>"}
    found, trivial = P.closure([P.parse("t.t0.a <= t.t1.a"), P.parse("t.t0.a <> t.t1.a")])
    assert P.parse("t.t0.a < t.t1.a") in found and not trivial
    assert P.closure([P.parse("t.t0.a == t.t1.a"), P.parse("t.t0.a < t.t1.a")])[1]
    assert P.parse("t.t0.a == t.t2.a") in P.closure([P.parse("t.t0.a == t.t1.a"), P.parse("t.t1.a == t.t2.a")])[0]
    index = P.RuleIndex()
    index.add([P.parse("t.t0.a == t.t1.a")], P.parse("t.t0.b == t.t1.b"))
    assert index.implied([P.parse("t.t0.a == t.t1.a"), P.parse("t.t0.c == t.t1.c")], P.parse("t.t0.b == t.t1.b"))
    assert not index.implied([P.parse("t.t0.c == t.t1.c")], P.parse("t.t0.b == t.t1.b"))


def test_spaces():
    space = P.column_predicates("t", {"a": "number", "b": "text"}, ordered=True) + P.constant_predicates("t", {"b": ["x"]}, ordered=True)
    assert len(space) == 6 + 2 + 4
    assert len(P.on_all_variables([P.parse("t.t0.a == t.t1.a")], 3)) == 3
    assert P.relevant([P.parse("u.t0.a == u.t1.a"), *space], [P.parse("t.t0.a == t.t1.a")]) == space
    assert {k[1] for k in P.grouped(space, {"a": "number"})} == {"single", "constant"} and len(P.right_hand_sides(space)) == 8
    kept = P.refined({frozenset([P.parse("t.t0.a == t.t1.a"), P.parse("u.t0.z == 1")]): 3, frozenset([P.parse("t.t0.a < t.t1.a")]): 9})
    assert kept == {frozenset([P.parse("t.t0.a == t.t1.a")]): 3}


def test_violations(table, rows):
    got = {tuple(r) for r in U.violating_pairs(table, [C.equal("t", "k")], C.equal("t", "y"), "id").collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if a[1] == b[1] and a[3] != b[3]}
    assert sum(r.conflicts for r in U.violating_groups(table, ["k"], "y").collect()) == len(got)
    lonely = {r.id for r in U.constant_violations(table, [C.equal("t", "k")], C.is_value("t", "y", "x"), "id").collect()}
    assert lonely == {a[0] for a in rows if a[3] != "x"}
    table.createOrReplaceTempView("t")
    rule = U.Rule.of([C.equal("t", "k")], C.equal("t", "y"))
    assert {tuple(r) for r in table.sparkSession.sql(rule.check_sql("id")).collect()} == got
    assert table.sparkSession.sql(rule.correct_sql("id")).columns == ["tid0", "tid1", "found", "wanted"]


def test_rule_comparison(spark):
    rule = lambda *c: U.Rule.of([C.equal("t", x) for x in c[:-1]], C.equal("t", c[-1]))
    a, b = U.as_table(spark, [rule("k", "y"), rule("k", "n", "m")]), U.as_table(spark, [rule("k", "n", "y"), rule("n", "m")])
    assert [r.rhs for r in U.uncovered(a, b).collect()] == ["t.t0.y == t.t1.y"] and U.uncovered(b, a).count() == 1
    assert {r.measure: r.share for r in U.compare(a, b).collect()} == {"precision": 0.5, "recall": 0.5}


def test_samples(table):
    s = A.uniform(table, 0.4, "id", 3)
    assert s.count() == 12 and {r.id for r in s.collect()} == {r.id for r in A.uniform(table, 0.4, "id", 3).collect()} != {r.id for r in A.uniform(table, 0.4, "id", 4).collect()}
    walk = A.random_walks(table, "id", ["k", "n"], 0.1, 3)
    assert 3 <= walk.count() <= 12 and walk.columns == table.columns
    for ratio in (0.05, 0.4, 0.9):
        found = [r.id for r in A.walk_sample(table, "id", ["k", "n"], ratio).collect()]
        assert len(found) == len(set(found)) == max(1, int(ratio * 30))
    places = A._numbered(table, "id", ["k", "n"], 1).collect()
    for attribute in "kn":
        by = {}
        for r in (r for r in places if r.attribute == attribute):
            by.setdefault((r.value, r.size), []).append(r.number)
        assert all(sorted(v) == list(range(1, n + 1)) for (_, n), v in by.items()) and sum(map(len, by.values())) == 30
    pairs = A.random_pairs(table, "id", 50).collect()
    assert len(pairs) == 50 and all(p.left_id < p.right_id for p in pairs)


def test_models(table):
    words = N.Vocabulary([C.equal("t", c) for c in COLUMNS])
    x, y = [[0, 0], [0, 1], [1, 0], [1, 1]], [0, 1, 1, 1]
    net = N.Network.random([2, 8, 1], "sigmoid").fit(x, y, 600, 0.05)
    assert ((net(x).ravel() > 0.5) == [False, True, True, True]).all()
    loaded = N.Network.loaded("1 0\n0 1\n\n0 0")
    assert (loaded([[2, 3]]) == [[2, 3]]).all()
    flat = N.Network([(N.np.zeros((6, 3)), N.np.array([0.9, -1.0, 0.5]))])
    assert N.expansion_filter(flat, words)([words.predicates[0]], words.predicates[1]) and N.upper_bound(flat, words, [], words.predicates[0]) == 0.9
    assert not N.action_allowed(flat, words, [], words.predicates[0], words.predicates[1]) and N.action_allowed(flat, words, [], words.predicates[0], words.predicates[2])
    score = N.EmbeddingScore({"t": N.np.ones(2), "k": N.np.array([0.0, 1])}, N.np.eye(2), N.np.ones(4))
    assert score([words.predicates[0], words.predicates[1]], words.predicates[2]) == 6 + 4 + 4
    env = N.Environment(words, words.predicates[2], lambda lhs, rhs: (10, 0.5 * len(lhs)), 5, 0.9)
    env.reset()
    assert env.step(0)[1:] == (0.5, False) and env.step(1)[1:] == (10.5, True)
    assert N.train_q(env, 5)(words.vector([])).shape == (1, 3)
    fates = {f for *_, f in N.training_paths(words, lambda lhs, rhs: (5 - 3 * len(lhs), 0.0), 1, 0.9, 5)}
    assert fates == {"FAILURE"}
    e = N.np.array([[1, 1, 0], [0, 0, 1], [1, 1, 1], [0, 0, 0]])
    assert N.sparse_neighbours(e, N.np.array([5.0, 5, 1, 1]), 1)[:2] == [[1], [0]]
    assert N.proportional(10, [1, 1, 98]) == [1, 1, 8]


def test_files(spark, table, tmp_path):
    files.write_csv(table, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), recursive=True).collect())) == sorted(tuple(map(str, r)) for r in table.collect())
    table.write.orc(str(tmp_path / "orc"))
    assert files.read_orc(spark, str(tmp_path / "orc"), "t_orc").count() == 30 == files.to_csv(spark, str(tmp_path / "orc"), str(tmp_path / "again")).count()
    assert set(files.read_tables(spark, {"t": str(tmp_path / "orc")}, "orc")) == {"t"}
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert files.read_types(spark, put("types", "t;k;varchar(20)\nt;n;int\n")) == {"t": {"k": "varchar(20)", "n": "int"}}
    assert [tuple(r) for r in files.read_constants(spark, put("c", "t->k;a;==\n")).collect()] == [("t", "k", "a", "==")]
    pairs = files.read_pairs(spark, put("ml", "ML;t->k;t->k;1;2;5;4;\nML#cosine@0.9(t->k;t->k):3|4;4|3;\n")).collect()
    assert {(r.predicate, r.tid0, r.tid1) for r in pairs} == {("ML;t->k;t->k", 1, 2), ("ML#cosine@0.9(t->k;t->k)", 3, 4)}
    files.write_evidence(spark.createDataFrame([([str(C.equal("t", "k"))], 7)], "predicates array<string>, n long"), str(tmp_path / "ev"))
    assert [(r.predicates, r.n) for r in files.read_evidence(spark, str(tmp_path / "ev")).collect()] == [(["t.t0.k == t.t1.k"], 7)]
    assert files.read_vocabulary(spark, put("voc", "t.t0.k == a\n")) == [P.parse("t.t0.k == a")]
    labels = files.read_labels(spark, put("labels.csv", "a,b,c,d\nt,1,t,2\nt,1,t,2\nt,2,u,1\n"))
    assert labels.count() == 2 and files.labelled_ids(labels).count() == 3
    rules = D.discover(table, "t", COLUMNS, support=1, confidence=0.5, levels=2)
    files.write_rules(spark, rules, str(tmp_path / "rules"))
    assert {str(r) for r in files.read_rules(spark, str(tmp_path / "rules"))} == {str(r) for r in rules}
    assert files.Settings.parse("# x\nsupport=0.1\ntop_k = 5\nother=1\n") == files.Settings(support=0.1, top_k=5)


def test_counts_by_classes(spark, monkeypatch):
    """Chains, and right-hand sides that order a pair, are counted without pairs, as every pair gives them."""
    import itertools
    import random

    r = random.Random(8)
    pick = r.choice
    ours = [(i, pick(("a", "b", "", None)), pick((1, 2, None)), pick((0.5, 1.5, 2.5, None))) for i in range(24)]
    theirs = [(i, pick(("a", "b", "c", "")), pick((1, 2, 3)), pick((0.5, 1.0, 2.5))) for i in range(15)]
    tables = {"o": spark.createDataFrame(ours, "id long, k string, n int, x double"), "c": spark.createDataFrame(theirs, "id long, k string, n int, x double")}
    rows = {"o": ours, "c": theirs}

    def value(row, c):
        v = row[("id", "k", "n", "x").index(c)]
        return None if v == "" else v

    def holds(p, at):
        x, y = value(at[p.left.variable], p.left.column), p.constant if p.is_constant else value(at[p.right.variable], p.right.column)
        return x is not None and y is not None and {"==": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[p.op]

    monkeypatch.setattr(D, "chain", lambda *a: pytest.fail("pairs were built"))
    cases = [
        (("o", "c", "c"), ["o.t0.k == c.t1.k", "c.t1.n == c.t2.n"]), (("o", "o", "c"), ["o.t0.k == o.t1.k", "o.t0.n == c.t2.n", "o.t1.x == c.t2.x"]),
        (("o", "o", "o"), ["o.t0.k == o.t1.k", "o.t1.n == o.t2.n", "o.t2.x == 1.5"]), (("o", "o", "o"), ["o.t0.k == o.t1.k", "o.t0.n == 1", "o.t0.x == o.t2.x"]), (("o", "o"), ["o.t0.k == o.t1.k"]),
    ]
    for names, lhs in cases:
        lhs = [P.parse(x) for x in lhs]
        lhs = [P.Predicate(p.left, p.op, constant=float(p.constant) if p.left.column == "x" else int(p.constant)) if p.is_constant else p for p in lhs]
        heads = [P.parse(f"{names[0]}.t0.{c} {op} {names[1]}.t1.{c}") for c, op in (("x", "<"), ("x", ">="), ("n", "=="), ("n", "<>"), ("x", "<="))] + [C.is_value(names[0], "n", 2)]
        found = {q.rhs: q for q in D.count_chain([tables[n] for n in names], ["id"] * len(names), lhs, heads).collect()}
        want = {}
        for at in itertools.product(*(rows[n] for n in names)):
            if all(at[u][0] != at[v][0] for u, v in itertools.combinations(range(len(names)), 2) if names[u] == names[v]) and all(holds(p, at) for p in lhs):
                want[at[0][0], at[1][0]] = at
        for h in heads:
            q = found[str(h)]
            hit = [at for at in want.values() if holds(h, at)]
            assert (q.support_x, q.rows0, q.support) == (len(want), len({a for a, _ in want}), len({at[0][0] for at in hit}) if h.is_constant else len(hit)), (names, str(h))
