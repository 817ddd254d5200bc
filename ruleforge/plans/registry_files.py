"""Queries over sources, sinks, the driver-side search operators and learned models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import counting as C
from ..operators import joins as J
from ..operators import matching as M
from ..operators import predicates as P
from ..operators import profile as R
from ..operators import sampling as A
from ..operators.shared import shared_dir
from ..sources import files
from . import discovery as D
from . import models as N
from . import rules as U
from .registry import _LINE, _ORDER_COLUMNS, _ORDER_CONSTANTS, _ORDER_RULES, _RULE, KEYS, Tables, _as_rows, _buckets_sql, _names, every_candidate, minimal_rules, query


def scratch(t: Tables) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(t.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def lines(t: Tables, rows, packed: str = "none") -> str:
    """A text file of the rows of a column, or of the given strings in their order."""
    path = scratch(t)
    if isinstance(rows, list):
        rows = t.spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)
    rows.write.text(path, compression=packed)
    return path


# ---------------------------------------------------------------- sources and sinks


@query("OP001_csv_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(t):
    path = scratch(t)
    files.write_csv(t.nation, path)
    return files.read_csv(t.spark, path, "nation_csv")


@query("OP002_orc_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = scratch(t)
    t.nation.write.orc(path)
    return files.read_orc(t.spark, path, "nation_orc")


@query("OP003_orc_to_csv", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def _(t):
    path = scratch(t)
    t.region.write.orc(path)
    return files.to_csv(t.spark, path, path + "-csv")


@query("OP004_recursive_csv", "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(t):
    path = scratch(t)
    for part in (0, 1):
        files.write_csv(t.nation.where(F.col("n_nationkey") % 2 == part).select("n_name", "n_regionkey"), f"{path}/deep/{part}")
    return files.read_csv(t.spark, path, recursive=True)


@query("OP008_constant_file", "SELECT DISTINCT 'orders' AS relation, 'o_orderpriority' AS \"column\", o_orderpriority AS value, '==' AS op FROM orders UNION ALL SELECT DISTINCT 'part', 'p_size', CAST(p_size AS VARCHAR), '<=' FROM part")
def _(t):
    status = t.orders.select(F.concat(F.lit("orders->o_orderpriority;"), "o_orderpriority", F.lit(";==")).alias("value")).distinct()
    return files.read_constants(t.spark, lines(t, status.union(t.part.select(F.concat(F.lit("part->p_size;"), F.col("p_size").cast("string"), F.lit(";<="))).distinct())))


#: Pairs of a line of a list.
LISTED = 4096
_NEIGHBOURS = "FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"


@query("OP009_pair_lists", f"SELECT 'ML;supplier->s_name;supplier->s_name' AS predicate, a.s_suppkey AS tid0, b.s_suppkey AS tid1 {_NEIGHBOURS} UNION ALL SELECT 'ML#cosine@0.9(supplier->s_name;supplier->s_name)', a.s_suppkey, b.s_suppkey {_NEIGHBOURS}")
def _(t):
    rows = t.supplier.select("s_nationkey", "s_suppkey")
    sizes = rows.groupBy("s_nationkey").agg(F.ceil(F.count("*") / LISTED).alias("pieces"))
    pieces = rows.join(sizes, "s_nationkey").groupBy("s_nationkey", F.pmod(F.xxhash64("s_suppkey"), "pieces").alias("piece")).agg(F.collect_list("s_suppkey").alias("ids"), F.count("*").alias("n"))
    made = J.dealt(rows, pieces, "s_nationkey", "s_suppkey", "n")
    others = made.select("s_suppkey", F.filter("ids_", lambda x: x != F.col("s_suppkey")).alias("ids")).where(F.size("ids") > 0)  # both ways: readers keep one
    i = F.col("s_suppkey").cast("string")
    listed = lambda head, between, tail: others.select(F.concat(F.lit(head), F.array_join(F.transform("ids", lambda j: F.concat(i, F.lit(between), j.cast("string"))), ";"), F.lit(tail)).alias("value"))  # noqa: E731  a line for a supplier and LISTED others or so
    return files.read_pairs(t.spark, lines(t, listed("ML;supplier->s_name;supplier->s_name;", ";", ";").union(listed("ML#cosine@0.9(supplier->s_name;supplier->s_name):", "|", ";")), "gzip"))


_MASKS = "SELECT (CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 1 ELSE 0 END) + (CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 2 ELSE 0 END) AS mask, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey GROUP BY 1"
_MASK_TEXTS = "list_filter([CASE WHEN mask & 2 = 2 THEN 'orders.t0.o_orderpriority == orders.t1.o_orderpriority' END, CASE WHEN mask & 1 = 1 THEN 'orders.t0.o_orderstatus == orders.t1.o_orderstatus' END], lambda x: x IS NOT NULL)"


def _evidence(t):
    """Evidence sets of orders by customer: predicates, n."""
    texts = [str(C.equal("orders", c)) for c in ("o_orderstatus", "o_orderpriority")]
    masks = R.evidence(t.orders, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_custkey")
    return masks.select("mask", F.array_sort(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(texts)]))).alias("predicates"), "n")


@query("OP010_evidence_file", f"SELECT {_MASK_TEXTS} AS predicates, CAST(n AS BIGINT) AS n FROM ({_MASKS}) WHERE mask > 0")
def _(t):
    path = scratch(t)
    files.write_evidence(_evidence(t).where("mask > 0"), path)
    return files.read_evidence(t.spark, path)


@query("OP011_vocabulary", "SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS number, 'customer.t0.c_mktsegment == ' || v AS predicate FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)")
def _(t):
    values = t.customer.select(F.concat(F.lit("customer.t0.c_mktsegment == "), "c_mktsegment").alias("value")).distinct().coalesce(1).sortWithinPartitions("value")
    return _list(t, files.read_vocabulary(t.spark, lines(t, values)))


@query("OP012_label_pairs", "SELECT DISTINCT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS row_id FROM labels UNION SELECT DISTINCT 'labels', CAST(quality AS VARCHAR) FROM labels")
def _(t):
    path = scratch(t)
    pairs = t.labels.select(F.lit("documents").alias("left_table"), F.col("doc_id").alias("left_row"), F.lit("labels").alias("right_table"), F.col("quality").alias("right_row"))
    files.write_csv(pairs.union(pairs), path)
    return files.labelled_ids(files.read_labels(t.spark, path))


@query("OP013_csv_writer", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang FROM documents")
def _(t):
    path = scratch(t)
    files.write_csv(t.documents.select("doc_id", "lang"), path)
    return files.read_csv(t.spark, path)


_MINED = minimal_rules(every_candidate("customer", ["c_nationkey", "c_mktsegment"], {}, 2)[0], 1, 0.01)
_MINED_LINE = _LINE.replace("orders ^ orders", "customer ^ customer")


def _mined(t):
    return D.discover(t.customer, "customer", ["c_nationkey", "c_mktsegment"], support=1, confidence=0.01, levels=2)


@query("OP014_rule_sink", f"{_MINED} SELECT {_MINED_LINE} AS value FROM r")
def _(t):
    path = scratch(t)
    files.write_rules(t.spark, _mined(t), path)
    return t.spark.read.text(path)


_READ_BACK = "lhs, rhs, CAST(level AS INTEGER) AS level, support, confidence"


@query("OP015_rule_source", f"{_MINED} SELECT {_READ_BACK} FROM r")
def _(t):
    path = scratch(t)
    files.write_rules(t.spark, _mined(t), path)
    return _as_rows(t, files.read_rules(t.spark, path)).drop("score")


@query("OP016_rule_source_orc", f"{_MINED} SELECT {_READ_BACK} FROM r")
def _(t):
    path = scratch(t)
    t.spark.createDataFrame([(str(r),) for r in _mined(t)] + [("no rule",)], "value string").write.orc(path)
    return _as_rows(t, files.read_rules(t.spark, path, "orc")).drop("score")


@query("OP017_settings", "SELECT CAST(0.01 AS DOUBLE) AS support, CAST(0.95 AS DOUBLE) AS confidence, 7 AS top_k")
def _(t):
    s = files.Settings.parse("# thresholds\nsupport = 0.01\nconfidence: 0.95\ntop_k=7\n")
    return t.spark.createDataFrame([(s.confidence, s.top_k)], "confidence double, top_k int").select(F.lit(s.support).alias("support"), "confidence", "top_k")


@query("OP019_matrices_as_text", "SELECT CAST(label AS INTEGER) AS layer, CAST(count(*) AS INTEGER) AS n_rows, 64 AS n_columns, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 3) AS total FROM embeddings GROUP BY label")
def _(t):
    rows = t.embeddings.select("label", F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ").alias("row"))
    found = rows.groupBy("label").agg(F.array_join(F.collect_list("row"), "\n").alias("text")).orderBy("label").collect()  # matrices of a model: kilobytes
    loaded = N.load_matrices("\n\n".join(r.text for r in found))
    return t.spark.createDataFrame([(r.label, *map(int, m.shape), round(float(m.sum()), 3)) for r, m in zip(found, loaded, strict=True)], "layer int, n_rows int, n_columns int, total double")


# ---------------------------------------------------------------- predicates and the search, on the driver


def _space():
    return P.column_predicates("part", {"p_brand": "text", "p_size": "number"}, ordered=True) + P.constant_predicates("part", {"p_brand": ["Brand#11", "Brand#12"]})


def _list(t, predicates):
    return t.spark.createDataFrame([(i, str(p)) for i, p in enumerate(predicates)], "number int, predicate string")


@query("OP024_printed_predicates", "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS number, 'part.t1.p_brand == ' || p_brand AS predicate FROM (SELECT DISTINCT p_brand FROM part)")
def _(t):
    brands = [r.value for r in R.sorted_dictionary(t.part, "p_brand").orderBy("code").collect()]  # a column's constants
    return _list(t, [P.parse(f" part.t1.p_brand  =  '{b}'") for b in brands])


@query("OP027_scorer_indicator", """WITH s AS (SELECT DISTINCT s_name FROM supplier), j AS (SELECT a.s_name AS a, b.s_name AS b, jaro_similarity(a.s_name, b.s_name) AS j, len(list_filter(range(1, least(length(a.s_name), length(b.s_name)) + 1), lambda i: substr(a.s_name, 1, CAST(i AS INTEGER)) = substr(b.s_name, 1, CAST(i AS INTEGER)))) AS k
    FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
  SELECT a, b, CASE WHEN (CASE WHEN j > 0.7 THEN j + least(0.1, 1.0 / greatest(length(a), length(b))) * k * (1 - j) ELSE j END) >= 0.99 THEN 1 ELSE 0 END AS similar FROM j""")  # fmt: skip
def _(t):
    pairs = J.group_pairs(t.supplier, "s_nationkey", "s_suppkey", ["s_name"]).select(F.col("s_name").alias("a"), F.col("s_name_").alias("b"))
    return pairs.select("a", "b", F.when(S.similarity_predicate("jaro-winkler", F.col("a"), F.col("b"), 0.99), 1).otherwise(0).alias("similar"))


@query("OP029_right_hand_sides")
def _(t):
    return _list(t, P.right_hand_sides(_space()))


@query("OP030_relevant_predicates", "SELECT 0 AS number, 'part.t0.p_brand == part.t1.p_brand' AS predicate")
def _(t):
    p = C.equal("part", "p_brand")
    return _list(t, P.relevant([p, C.equal("orders", "o_custkey")], [p]))


@query("OP033_refined_evidence", f"SELECT array_to_string({_MASK_TEXTS}, ';') AS predicates, CAST(n AS BIGINT) AS n FROM ({_MASKS}) WHERE mask > 0")
def _(t):
    other = C.is_value("customer", "c_mktsegment", "BUILDING")  # of another relation: it goes, and equal rests are added up
    found = {}
    for r in _evidence(t).collect():  # a row a mask
        own = [P.parse(x) for x in r.predicates]
        found[frozenset(own)], found[frozenset([*own, other])] = r.n - r.n // 2, r.n // 2
    return t.spark.createDataFrame([(";".join(sorted(map(str, k))), n) for k, n in P.refined(found).items()], "predicates string, n long")


@query("OP078_diversity_counters", f"{_ORDER_RULES}, u AS (SELECT DISTINCT mask, rhs, unnest(regexp_extract_all(array_to_string(lhs, ' ') || ' ' || rhs, '\\.t[01]\\.(\\w+)', 1)) AS c FROM r) SELECT c AS \"column\", CAST(100 + count(*) AS INTEGER) AS used FROM u GROUP BY c")
def _(t):
    i = D.Interest(1)
    i.count(_order_rules(t))
    return t.spark.createDataFrame(list(i.used.items()), "column string, used int")


def _order_search(t, **options):
    pairs = [C.equal("orders", c) for c in _ORDER_COLUMNS]
    return D.mine(D.Source({"orders": t.orders}, {"orders": "o_orderkey"}), pairs, P.constant_predicates("orders", _ORDER_CONSTANTS), pairs, **{"support": 100, "confidence": 0.19, "levels": 3, **options})


def _order_rules(t, **options):
    return _order_search(t, **options).rules


@query("OP083_correlated_neighbours")
def _(t):
    columns = ["p_brand", "p_type", "p_name", "p_retailprice"]
    rows = R.evidence(t.part, "p_partkey", ["p_size", *columns], "p_size").collect()  # a row a mask
    e = np.array([[r.mask >> b & 1 for b in range(len(columns))] for r in rows], float)
    near = N.sparse_neighbours(e, np.array([float(r.n) for r in rows]), 2)
    return t.spark.createDataFrame([(c, [columns[j] for j in n]) for c, n in zip(columns, near, strict=True)], "predicate string, neighbours array<string>")


@query("OP091_predicate_sets", "SELECT 3 AS a, 6 AS b, 2 AS both, 7 AS either, 5 AS one, 1 AS without, false AS subset")
def _(t):
    index = P.RuleIndex()
    p, q, r = C.equal("t", "a"), C.equal("t", "b"), C.equal("t", "c")
    index.mask([p, q, r])
    a, b = index.mask([p, q]), index.mask([q, r])
    return t.spark.createDataFrame([(a, b, a & b, a | b, a ^ b, a & ~b, a & ~b == 0)], "a int, b int, both int, either int, one int, without int, subset boolean")


_PAIR_TABLES = ("customer", "nation", "region", "supplier")


def _overlap_sql() -> str:
    columns = {"customer": {"c_custkey": "k", "c_nationkey": "i", "c_acctbal": "d", "c_name": "s", "c_mktsegment": "s"}, "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"}, "region": {"r_regionkey": "i", "r_name": "s"}, "supplier": {"s_suppkey": "k", "s_nationkey": "i", "s_acctbal": "d", "s_name": "s"}}
    every = [(t, c, k) for t in columns for c, k in columns[t].items()]
    parts = []
    for t, a, k in every:
        for u, b, m in every:
            if t > u or t == u and a > b:
                continue
            join = "true" if (t, a) == (u, b) else f"coalesce((SELECT sum(least(n, coalesce(m, 0))) / sum(greatest(n, coalesce(m, 0))) FROM (SELECT {a} AS v, count(*) AS n FROM {t} GROUP BY 1) x LEFT JOIN (SELECT {b} AS v, count(*) AS m FROM {u} GROUP BY 1) y USING (v)) > 0.3, false)" if t < u and k == m else "false"
            ratio = lambda f, t=t, a=a, u=u, b=b: f"(SELECT CASE WHEN greatest(abs(x), abs(y)) = 0 THEN 1 ELSE least(abs(x), abs(y)) / greatest(abs(x), abs(y)) END FROM (SELECT {f}({a}) AS x FROM {t}), (SELECT {f}({b}) AS y FROM {u})) > 0.3"
            alike = f"({ratio('avg')} AND {ratio('stddev_pop')})" if k != "s" and m != "s" else "false"
            parts.append(f"SELECT '{t}' AS \"left\", '{a}' AS a, '{u}' AS \"right\", '{b}' AS b, {join} AS joinable, {alike} AS comparable")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE joinable OR comparable"


def _column_pairs(t):
    return R.column_pairs({n: getattr(t, n) for n in _PAIR_TABLES})


@query("OP140_column_pairs", _overlap_sql())
def _(t):
    return _column_pairs(t)


_PAIR_OPS = """unnest(CASE WHEN joinable THEN ['==', '<>'] ELSE [] END || CASE WHEN comparable THEN ['<', '<=', '>', '>='] ELSE [] END)"""


@query("OP143_predicates_of_column_pairs", f"""WITH p AS ({_overlap_sql()}), o AS (SELECT *, {_PAIR_OPS} AS op FROM p)
  SELECT "left" || '.t0.' || a || ' ' || op || ' ' || "right" || '.t1.' || b AS predicate FROM o
  UNION SELECT unnest(['customer.t0.c_nationkey == nation.t1.n_nationkey', 'nation.t0.n_nationkey == customer.t1.c_nationkey', 'nation.t0.n_regionkey == region.t1.r_regionkey', 'region.t0.r_regionkey == nation.t1.n_regionkey'])""")  # fmt: skip
def _(t):
    tables = {n: getattr(t, n) for n in _PAIR_TABLES}
    pairs = [tuple(r) for r in R.column_pairs(tables).collect()]  # pairs of columns of the schema
    text = {(n, f.name) for n, d in tables.items() for f in d.schema if f.dataType.typeName() == "string"}
    keys = [(k.table, k.column, k.other, k.other_column) for k in KEYS if k.table in tables and k.other in tables]
    return _list(t, P.pair_predicates(pairs, text, keys)).select("predicate")


@query("OP144_constant_predicates")
def _(t):
    return _list(t, P.constant_predicates("part", {"p_size": [1, 2]}, ordered=True))


@query("OP145_grouped_predicates", "SELECT 'number' AS kind, 'single' AS shape, 6 AS n UNION ALL SELECT 'text', 'constant', 4 UNION ALL SELECT 'text', 'single', 2")
def _(t):
    return t.spark.createDataFrame([(*k, len(v)) for k, v in P.grouped(_space(), {"p_size": "number"}).items()], "kind string, shape string, n int")


@query("OP146_predicates_on_variables", "SELECT 0 AS number, 'part.t0.p_brand == part.t1.p_brand' AS predicate UNION ALL SELECT 1, 'part.t0.p_brand == part.t2.p_brand' UNION ALL SELECT 2, 'part.t1.p_brand == part.t2.p_brand'")
def _(t):
    return _list(t, P.on_all_variables([C.equal("part", "p_brand")], 3))


@query("OP147_operator_algebra", "SELECT * FROM (VALUES ('==', '<>', '==', '== <= >='), ('<>', '==', '<>', '<>'), ('<', '>=', '>', '< <= <>'), ('<=', '>', '>=', '<='), ('>', '<=', '<', '> >= <>'), ('>=', '<', '<=', '>=')) AS v(op, inverse, \"symmetric\", implies)")
def _(t):
    p = {o: P.Predicate(P.Operand("t", 0, "a"), o, P.Operand("t", 1, "a")) for o in P.OPERATORS}
    return t.spark.createDataFrame([(o, x.inverse().op, x.symmetric().op, " ".join(y.op for y in x.implications())) for o, x in p.items()], "op string, inverse string, symmetric string, implies string")


@query("OP148_closure")
def _(t):
    found, _ = P.closure([P.parse("t.t0.a <= t.t1.a"), P.parse("t.t0.a <> t.t1.a"), P.parse("t.t1.a == t.t2.a")])
    return _list(t, sorted(found, key=str))


_LEVEL_TWO = every_candidate("orders", _ORDER_COLUMNS, {}, 2)[0]


@query("OP149_implied_rules", f"{_LEVEL_TWO} SELECT lhs, rhs, EXISTS (SELECT 1 FROM c w WHERE w.rhs = c.rhs AND w.level = 1 AND w.confidence >= 0.19 AND (w.mask & c.mask) = w.mask) AS implied FROM c WHERE level = 2")
def _(t):
    index, pairs = P.RuleIndex(), [C.equal("orders", c) for c in _ORDER_COLUMNS]
    for r in D.discover(t.orders, "orders", _ORDER_COLUMNS, support=1, confidence=0.19, levels=1):
        index.add(r.lhs, r.rhs)
    sets = [(frozenset((a, b)), p) for i, a in enumerate(pairs) for b in pairs[i + 1 :] for p in pairs if p not in (a, b)]
    return t.spark.createDataFrame([(sorted(map(str, x)), str(p), index.implied(x, p)) for x, p in sets], "lhs array<string>, rhs string, implied boolean")


_EVERY = every_candidate("orders", _ORDER_COLUMNS, _ORDER_CONSTANTS, 3)[0]


def _levels(t, **options):
    found = _order_search(t, **options)
    return t.spark.createDataFrame([tuple(x.values()) for x in found.log], ", ".join(f"{k} long" for k in found.log[0]))


@query("OP152_work_units", f"{_EVERY} SELECT lhs, rhs FROM c WHERE level <= 2 UNION ALL SELECT ['orders.t0.o_custkey == orders.t1.o_custkey'], 'orders.t0.o_orderstatus == ' || v FROM (VALUES ('F'), ('O')) AS w(v) UNION ALL SELECT ['orders.t0.o_orderpriority == orders.t1.o_orderpriority'], 'orders.t0.o_orderstatus == ' || v FROM (VALUES ('F'), ('O')) AS w(v) UNION ALL SELECT ['orders.t0.o_custkey == orders.t1.o_custkey', 'orders.t0.o_orderpriority == orders.t1.o_orderpriority'], 'orders.t0.o_orderstatus == ' || v FROM (VALUES ('F'), ('O')) AS w(v) UNION ALL SELECT list_sort([k, 'orders.t1.o_orderstatus == ' || v]), 'orders.t0.o_orderstatus == ' || u FROM (VALUES ('F'), ('O')) AS w(v), (VALUES ('F'), ('O')) AS x(u), (VALUES ('orders.t0.o_custkey == orders.t1.o_custkey'), ('orders.t0.o_orderpriority == orders.t1.o_orderpriority')) AS y(k) WHERE false")
def _(t):
    pairs, fixed = [C.equal("orders", c) for c in _ORDER_COLUMNS], P.constant_predicates("orders", _ORDER_CONSTANTS)
    level = [frozenset([p]) for p in pairs + fixed]
    sets = level + D.expand(level, set(level))
    heads = pairs + [p for p in fixed if p.left.variable == 0]
    return t.spark.createDataFrame([(sorted(map(str, s)), str(p)) for s in sets for p in heads if p not in s and D.countable(s, p)], "lhs array<string>, rhs string")


@query("OP151_first_level", f"{_EVERY} SELECT DISTINCT lhs, support_x FROM c WHERE level = 1")
def _(t):
    found = _order_search(t, levels=1)
    return t.spark.createDataFrame(sorted({(tuple(sorted(map(str, x))), c["support_x"]) for x, _, c in found.counted}), "lhs array<string>, support_x long")


@query("OP153_level_expansion", f"{_EVERY} SELECT lhs, rhs, CAST(level AS INTEGER) AS level, support_x, support, confidence FROM c WHERE level <= 2")
def _(t):
    found = _order_search(t, levels=2, support=1, confidence=1.1)  # nothing is valid, so every candidate is counted
    return t.spark.createDataFrame([(sorted(map(str, x)), str(y), len(x), c["support_x"], c["support"], c["confidence"]) for x, y, c in found.counted], "lhs array<string>, rhs string, level int, support_x long, support long, confidence double")


@query("OP157_pruned_by_bound", f"{minimal_rules(_EVERY, 100, 0.05)} SELECT {_RULE} FROM r ORDER BY score DESC, {_LINE} LIMIT 2")
def _(t):
    return _as_rows(t, _order_rules(t, confidence=0.05, top=2))


@query("OP158_heads_left_by_parents", f"""{_EVERY}, s AS (SELECT * FROM c WHERE level = 2 AND support_x >= 0 AND NOT EXISTS (SELECT 1 FROM c w WHERE w.rhs = c.rhs AND w.level = 1 AND (w.mask & c.mask) = w.mask AND (w.support < 100 OR w.confidence >= 0.19)))
  SELECT lhs, rhs FROM s""")  # fmt: skip
def _(t):
    found = _order_search(t, levels=2)
    return t.spark.createDataFrame([(sorted(map(str, x)), str(y)) for x, y, _ in found.counted if len(x) == 2], "lhs array<string>, rhs string")


@query("OP160_work_by_x", f"{_EVERY} SELECT lhs, list_sort(list(rhs)) AS heads, CAST(any_value(support_x) AS BIGINT) AS support_x FROM c WHERE level <= 2 GROUP BY lhs")
def _(t):
    found, by = _order_search(t, levels=2, support=1, confidence=1.1), {}
    for x, y, c in found.counted:
        by.setdefault(tuple(sorted(map(str, x))), (c["support_x"], []))[1].append(str(y))
    return t.spark.createDataFrame([(list(x), sorted(h), n) for x, (n, h) in by.items()], "lhs array<string>, heads array<string>, support_x long")


@query("OP161_levels_of_one_pass", f"{_EVERY} SELECT CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS candidates, CAST(1 AS BIGINT) AS jobs FROM c GROUP BY level")
def _(t):
    return _levels(t, support=1, confidence=1.1).select("level", "candidates", "jobs")


@query("OP163_covered_by_templates")
def _(t):
    found = _order_search(t, confidence=0.15, templates=True)
    return t.spark.createDataFrame([tuple(x.values()) for x in found.log], ", ".join(f"{k} long" for k in found.log[0])).select("level", "candidates", "by_template", "valid")


@query("OP093_shared_heads", "SELECT 'orders.t0.o_orderpriority == orders.t1.o_orderpriority' AS heads")
def _(t):
    a, b, c = (C.equal("orders", x) for x in ("o_custkey", "o_orderstatus", "o_orderpriority"))
    found = D.shared_heads([(frozenset([a]), frozenset([b, c])), (frozenset([a]), frozenset([c]))])
    return t.spark.createDataFrame([(" ".join(sorted(map(str, h))),) for h in found.values()], "heads string")


@query("OP164_three_variable_rule", """WITH p AS (SELECT DISTINCT a.o_orderkey x, b.o_orderkey y, a.o_orderpriority = b.o_orderpriority AS eq FROM orders a, orders b, customer c
  WHERE a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderkey <> b.o_orderkey AND b.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING')
  SELECT CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (eq) AS BIGINT) AS support, round(count(*) FILTER (eq) / count(*), 9) AS confidence FROM p""")  # fmt: skip
def _(t):
    o = t.orders
    third = P.Predicate(P.Operand("orders", 1, "o_custkey"), "==", P.Operand("customer", 2, "c_custkey"))
    lhs = [C.equal("orders", "o_custkey"), C.equal("orders", "o_orderstatus"), third, C.is_value("customer", "c_mktsegment", "BUILDING", 2)]
    return D.evaluate_chain([o, o, t.customer], ["o_orderkey", "o_orderkey", "c_custkey"], lhs, C.equal("orders", "o_orderpriority"))


_PART_RULES = minimal_rules(every_candidate("part", ["p_brand", "p_type", "p_size"], {}, 3)[0], 1, 0.01)


@query("OP166_full_search", f"{_PART_RULES} SELECT {_RULE} FROM r")
def _(t):
    return _as_rows(t, D.discover(t.part, "part", ["p_brand", "p_type", "p_size"], support=1, confidence=0.01, levels=4))


@query("OP168_constant_templates")
def _(t):
    rules = D.discover(t.orders, "orders", ["o_custkey", "o_orderpriority"], constants={"o_orderstatus": ["F", "O"]}, support=1, confidence=0.001, levels=2)
    found = sorted({(" ".join(k), " ".join(a), " ".join(b), str(rhs)) for k, a, b, rhs in map(D.template, rules)})
    return t.spark.createDataFrame(found, "keys string, fixed0 string, fixed1 string, rhs string")


@query("OP081_ranked_in_clusters", """WITH u AS (SELECT vec_id, label, embedding AS e FROM embeddings), d AS (SELECT a.vec_id, a.label, round(sum(1 - list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[]))), 6) AS s FROM u a JOIN u b ON a.label = b.label GROUP BY 1, 2)
  SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM d) WHERE r <= 1""")  # fmt: skip
def _(t):
    return A.cluster_ranked(t.embeddings, "vec_id", "embedding", "label", 0.0).select("vec_id", "label")


_FIXED = "(SELECT 'orders.t' || v || '.' || c || ' == ' || x AS p, v, c FROM (SELECT DISTINCT 'o_orderstatus' AS c, o_orderstatus AS x FROM orders UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders), (VALUES (0), (1)) AS w(v))"


@query("OP155_one_constant_a_column", f"SELECT a.p AS first, b.p AS second FROM {_FIXED} a JOIN {_FIXED} b ON a.p < b.p AND (a.v <> b.v OR a.c <> b.c)")
def _(t):
    values = {c: [r.value for r in C.histogram(t.orders, c).select("value").collect()] for c in ("o_orderstatus", "o_orderpriority")}  # constants of two columns
    fixed = sorted(P.constant_predicates("orders", values), key=str)
    return t.spark.createDataFrame([(str(a), str(b)) for i, a in enumerate(fixed) for b in fixed[i + 1 :] if D.compatible(frozenset([a, b]))], "first string, second string")


@query("OP156_minimal_rules", f"{minimal_rules(_EVERY, 1, 0.15)} SELECT lhs, rhs FROM r")
def _(t):
    return t.spark.createDataFrame([([str(p) for p in r.lhs], str(r.rhs)) for r in _order_rules(t, support=1, confidence=0.15)], "lhs array<string>, rhs string")


@query("OP159_confidence_filter", f"{minimal_rules(every_candidate('orders', _ORDER_COLUMNS, {}, 2)[0], 1, 0.19)} SELECT {_RULE} FROM r WHERE level = 1 OR NOT EXISTS (SELECT 1 FROM c w WHERE w.level = 1 AND (w.mask & r.mask) = w.mask GROUP BY w.mask HAVING max(w.confidence) < 0.001)")
def _(t):
    return _as_rows(t, D.discover(t.orders, "orders", _ORDER_COLUMNS, support=1, confidence=0.19, levels=2, confidence_filter=True))


@query("OP171_score_bound", f"{_ORDER_RULES} SELECT lhs, rhs, round(0.4 * support / n / sqrt(n) + 0.2 + 0.2 / (100 + 1e-5) + 0.1 / level + 0.1, 9) AS bound, round(0.4 * support / n / sqrt(n) + 0.2 + 0.2 / (100 + 1e-5) + 0.1 / level + 0.1, 9) >= score AS holds FROM r")
def _(t):
    i = D.Interest(t.orders.count())
    rows = [([str(p) for p in r.lhs], str(r.rhs), round(b := i.bound(r.support, len(r.lhs)), 9), b >= r.score) for r in _order_rules(t)]
    return t.spark.createDataFrame(rows, "lhs array<string>, rhs string, bound double, holds boolean")


@query("OP174_recovered_one_sided", """WITH p AS (SELECT a.o_orderstatus AS c0_o_orderstatus, a.o_orderpriority = b.o_orderpriority AS eq FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey)
  SELECT c0_o_orderstatus, CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (eq) AS BIGINT) AS support, round(count(*) FILTER (eq) / count(*), 9) AS confidence FROM p GROUP BY 1 HAVING count(*) FILTER (eq) >= 50""")  # fmt: skip
def _(t):
    return C.as_longs(D.recover(t.orders, ["o_custkey"], ["o_orderstatus"], [], "o_orderpriority", 50, 0.0))


@query("OP175_recovered_from_sample", """WITH p AS (SELECT a.o_orderstatus AS s, b.o_orderstatus AS t, a.o_orderkey AS k, a.o_orderpriority AS y, a.o_orderpriority = b.o_orderpriority AS eq FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey),
  one AS (SELECT s, count(*) FILTER (eq) AS n, round(count(*) FILTER (eq) / count(*), 9) AS c FROM p GROUP BY s), u AS (SELECT DISTINCT s, t, k, y FROM p), h AS (SELECT s, t, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY s, t) AS total, row_number() OVER (PARTITION BY s, t ORDER BY count(*) DESC, y) AS r FROM u GROUP BY s, t, y)
  SELECT list_sort(['orders.t0.o_custkey == orders.t1.o_custkey', 'orders.t0.o_orderstatus == ' || s]) AS lhs, 'orders.t0.o_orderpriority == orders.t1.o_orderpriority' AS rhs, CAST(n AS BIGINT) AS support, c AS confidence, 'recovered' AS origin FROM one WHERE n >= 50 AND c >= 0.001
  UNION ALL SELECT list_sort(['orders.t0.o_custkey == orders.t1.o_custkey', 'orders.t0.o_orderstatus == ' || s, 'orders.t1.o_orderstatus == ' || t]), 'orders.t0.o_orderpriority == ' || y, CAST(n AS BIGINT), round(n / total, 9), 'recovered' FROM h WHERE r = 1 AND n >= 50 AND n / total >= 0.001
  UNION ALL SELECT ['orders.t0.o_custkey == orders.t1.o_custkey'], 'orders.t0.o_orderstatus == orders.t1.o_orderstatus', 7, 0.5, 'sample'""")  # fmt: skip
def _(t):
    same, priority = C.equal("orders", "o_custkey"), C.equal("orders", "o_orderpriority")
    rules = [U.Rule.of([same, C.is_value("orders", "o_orderstatus", "F")], priority), U.Rule.of([same], C.equal("orders", "o_orderstatus"), support=7, confidence=0.5)]
    rules += [U.Rule.of([same, C.is_value("orders", "o_orderstatus", "F"), C.is_value("orders", "o_orderstatus", "O", 1)], C.is_value("orders", "o_orderpriority", "2-HIGH"))]
    # of the sample's rules with constants only their templates matter
    return D.recover_rules(t.orders, "orders", rules, 50, 0.001).where("origin = 'recovered' or size(lhs) = 1")


@query("OP175b_recovered_after_search")
def _(t):
    sample = A.uniform(t.orders, 0.3, "o_orderkey")
    rules = D.discover(sample, "orders", ["o_custkey", "o_orderpriority"], constants={"o_orderstatus": ["F", "O"]}, support=5, confidence=0.001, levels=2, constant_rhs=True)
    return D.recover_rules(t.orders, "orders", rules, 50, 0.001)


@query("OP181_correlation_filter", f"{_LEVEL_TWO} SELECT lhs[1] AS predicate, rhs FROM c WHERE level = 1 AND confidence >= 0.19")
def _(t):
    pairs = [C.equal("orders", c) for c in _ORDER_COLUMNS]
    listed = {(str(*r.lhs), str(r.rhs)) for r in D.discover(t.orders, "orders", _ORDER_COLUMNS, support=0, confidence=0.19, levels=1)}
    return t.spark.createDataFrame([(str(p), str(y)) for y in pairs for p in P.correlated(pairs, y, listed)], "predicate string, rhs string")


@query("OP182_sparse_inverse_covariance")
def _(t):
    columns = ["o_orderstatus", "o_orderpriority", "o_orderdate"]
    rows = R.evidence(t.orders.withColumn("o_orderdate", F.month("o_orderdate")), "o_orderkey", ["o_custkey", *columns], "o_custkey").collect()  # a row a mask
    e = np.array([[r.mask >> b & 1 for b in range(len(columns))] for r in rows], float)
    near = N.sparse_neighbours(e, np.array([float(r.n) for r in rows]), len(columns))
    return t.spark.createDataFrame([(c, [columns[j] for j in n]) for c, n in zip(columns, near, strict=True)], "predicate string, neighbours array<string>")


@query("OP183_proportional_thresholds", """WITH RECURSIVE w AS (SELECT o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total FROM w),
  s0 AS (SELECT list(part ORDER BY part) AS parts, list(CAST(greatest(1, ceil(100 * n / total)) AS BIGINT) ORDER BY part) AS shares FROM w, t),
  d AS (SELECT parts, shares FROM s0 UNION ALL SELECT parts, [CASE WHEN i = list_position(shares, list_max(shares)) THEN shares[i] - 1 ELSE shares[i] END FOR i IN range(1, len(shares) + 1)] FROM d WHERE list_sum(shares) > greatest(100, len(shares)))
  SELECT unnest(parts) AS part, unnest(shares) AS share FROM d WHERE list_sum(shares) <= greatest(100, len(shares))""")  # fmt: skip
def _(t):
    rows = sorted(map(tuple, C.histogram(t.orders, "o_orderstatus").collect()))  # three parts
    return t.spark.createDataFrame(list(zip([p for p, _ in rows], N.proportional(100, [n for _, n in rows]), strict=True)), "part string, share long")


@query("OP183b_evidence_parts")
def _(t):
    return N.evidence_parts(_evidence(t).select("mask", "n"), 2, 2, 100)


@query("OP193_one_step_walks")
def _(t):
    return A.random_walks(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", ["c_nationkey", "c_mktsegment"], 0.02, 1, seed=5)


# ---------------------------------------------------------------- learned models


def _words():
    return N.Vocabulary([C.equal("orders", c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")])


def _measure(t):
    known: dict = {}

    def run(lhs, rhs):
        key = (frozenset(lhs), rhs)
        if key not in known:
            row = D.evaluate(t.orders, [(list(lhs), rhs)]).first()
            known[key] = (int(row.support_x), float(row.confidence))
        return known[key]

    return run


@query("OP210_expansion_filter")
def _(t):
    w = _words()
    x = np.array([w.vector([p], q) for p in w.predicates for q in w.predicates])
    y = np.array([float(p == q) for p in w.predicates for q in w.predicates])
    prune = N.expansion_filter(N.Network.random([6, 8, 1], "sigmoid").fit(x, y, 400, 0.05), w)
    return t.spark.createDataFrame([(str(p), str(q), bool(prune([p], q))) for p in w.predicates for q in w.predicates], "lhs string, rhs string, pruned boolean")


@query("OP211_learned_bound")
def _(t):
    w = _words()
    net = N.Network.random([6, 4, 1])
    return t.spark.createDataFrame([(str(p), round(N.upper_bound(net, w, [p], w.predicates[0]), 9)) for p in w.predicates[1:]], "lhs string, bound double")


@query("OP212_action_values")
def _(t):
    w = _words()
    q = N.q_values(N.Network.random([6, 4, 3]), w, [w.predicates[0]], w.predicates[2])
    ok = N.legal(w, [w.predicates[0]], w.predicates[2])
    return t.spark.createDataFrame([(str(p), round(float(v), 9), bool(o)) for p, v, o in zip(w.predicates, q, ok, strict=True)], "predicate string, value double, legal boolean")


@query("OP213_embedding_score")
def _(t):
    w, r = _words(), np.random.default_rng(1)
    tokens = {x: r.normal(size=4) for p in w.predicates for x in N.EmbeddingScore.words_of(p)}
    score = N.EmbeddingScore(tokens, r.normal(size=(4, 4)), r.normal(size=8))
    return t.spark.createDataFrame([(str(p), str(q), round(score([p], q), 9)) for p in w.predicates for q in w.predicates if p != q], "lhs string, rhs string, score double")


@query("OP214_environment_steps")
def _(t):
    w = _words()
    env = N.Environment(w, w.predicates[2], _measure(t), 1000, 0.9)
    env.reset()
    out = []
    for i in range(2):
        _, reward, done = env.step(i)
        out.append((i, str(w.predicates[i]), round(reward, 9), done))
    return t.spark.createDataFrame(out, "step int, added string, reward double, done boolean")


@query("OP215_training_paths")
def _(t):
    w = _words()
    found = N.training_paths(w, _measure(t), 1000, 0.9, 6)
    return t.spark.createDataFrame([([str(p) for p in lhs], str(rhs), fate) for lhs, rhs, fate in found], "lhs array<string>, rhs string, fate string")


@query("OP216_trained_values")
def _(t):
    w = _words()
    net = N.train_q(N.Environment(w, w.predicates[2], _measure(t), 1000, 0.9), 4)
    return t.spark.createDataFrame([(str(p), round(float(v), 6)) for p, v in zip(w.predicates, N.q_values(net, w, [], w.predicates[2]), strict=True)], "predicate string, value double")


@query("OP216b_trained_filter")
def _(t):
    w = _words()
    net = N.train_filter(w, N.training_paths(w, _measure(t), 1000, 0.9, 12))
    return t.spark.createDataFrame([(str(p), str(q), round(float(net(w.vector([p], q))[0, 0]), 6)) for p in w.predicates for q in w.predicates if p != q], "lhs string, rhs string, failure double")


@query("OP216c_trained_interestingness")
def _(t):
    w, r = _words(), np.random.default_rng(1)
    tokens = {x: r.normal(size=4) for p in w.predicates for x in N.EmbeddingScore.words_of(p)}
    rules = D.discover(t.orders, "orders", _ORDER_COLUMNS, support=1, confidence=0.1, levels=2)
    pairs = [((a.lhs, a.rhs), (b.lhs, b.rhs)) for i, a in enumerate(rules) for b in rules[i + 1 :] if a.score > b.score]
    score = N.EmbeddingScore(tokens, r.normal(size=(4, 4)), r.normal(size=8)).fit(pairs)
    return t.spark.createDataFrame([([str(p) for p in x.lhs], str(x.rhs), round(score(x.lhs, x.rhs), 6)) for x in rules], "lhs array<string>, rhs string, score double")


@query("OP217_online_learning")
def _(t):
    pairs, fixed = [C.equal("orders", c) for c in _ORDER_COLUMNS], P.constant_predicates("orders", _ORDER_CONSTANTS)
    online = N.OnlineFilter(N.Vocabulary(pairs + fixed), 1000)
    return _as_rows(t, _order_rules(t, support=1000, confidence=0.15, learn=online.learn, prune=online.prune))


@query("OP217b_pruned_search")
def _(t):
    w = _words()
    net = N.train_q(N.Environment(w, w.predicates[2], _measure(t), 1000, 0.9), 4)
    prune = lambda lhs, rhs: rhs != w.predicates[2] or not any(N.action_allowed(net, w, [], rhs, p) for p in lhs if p in w.number and p != rhs)
    return U.as_table(t.spark, D.discover(t.orders, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"], support=1, confidence=0.1, levels=2, prune=prune))


@query("OP202b_superbit_buckets", _buckets_sql(M.superbit(16, 2, 64)))
def _(t):
    return M.buckets(t.embeddings, "vec_id", "embedding", M.superbit(16, 2, 64))
