"""The queries over the library's operators, over whole tables, and the SQL that checks them.

SQL is written another way than the operator where that is possible: counts of pairs by explicit
self-joins, for example, against the operators' group sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import textclean as T
from ..operators import counting as C
from ..operators import joins as J
from ..operators import matching as M
from ..operators import predicates as P
from ..operators import profile as R
from ..operators import sampling as A
from . import discovery as D
from . import rules as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def queries() -> dict:
    from . import registry_files  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


def named(column: DataFrame, label: str) -> DataFrame:
    return column.select(F.lit(label).alias("name"), *column.columns)


# ---------------------------------------------------------------- tables and columns


@query("OP005_prefix_by_ratio", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) r, count(*) OVER () n FROM orders) WHERE r <= greatest(1, floor(0.1 * n))")
def _(t):
    return R.prefix(t.orders.select("o_orderkey", "o_custkey"), 0.1, "o_orderkey")


@query("OP006_type_inference", """SELECT 'c_custkey' AS "column", 'LONG' AS type UNION ALL SELECT 'c_name', 'STRING' UNION ALL SELECT 'c_nationkey', CASE WHEN (SELECT bool_and(regexp_full_match(CAST(c_nationkey AS VARCHAR), '[+-]?[0-9]+')) FROM customer) THEN 'LONG' ELSE 'NUMERIC' END
  UNION ALL SELECT 'c_acctbal', 'NUMERIC' UNION ALL SELECT 'c_mktsegment', 'STRING'""")  # fmt: skip
def _(t):
    return R.inferred_types(t.customer)


@query("OP007_declared_types", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS code, CAST(NULL AS BIGINT) AS p_brand FROM part")
def _(t):
    d = t.part.select("p_partkey", "p_size", F.regexp_extract("p_brand", "[0-9]+", 0).alias("code"), "p_brand")
    return R.declared(d, {"p_partkey": "varchar(20)", "p_size": "double", "code": "int", "p_brand": "bigint"})


@query("OP020_comparison_predicates", """SELECT op, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest([CASE WHEN a.n_regionkey = b.n_regionkey THEN '==' END, CASE WHEN a.n_regionkey <> b.n_regionkey THEN '<>' END, CASE WHEN a.n_regionkey < b.n_regionkey THEN '<' END,
    CASE WHEN a.n_regionkey <= b.n_regionkey THEN '<=' END, CASE WHEN a.n_regionkey > b.n_regionkey THEN '>' END, CASE WHEN a.n_regionkey >= b.n_regionkey THEN '>=' END]) AS op
  FROM nation a, nation b) WHERE op IS NOT NULL GROUP BY op""")  # fmt: skip
def _(t):
    return C.as_longs(C.order_support(t.nation, "n_regionkey", t.nation, "n_regionkey"))


@query("OP021_constant_predicates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 300000")
def _(t):
    ps = [P.Predicate(P.Operand("orders", 0, "o_orderstatus"), "==", constant="F"), P.Predicate(P.Operand("orders", 0, "o_totalprice"), ">=", constant=300000)]
    return reduce(lambda d, p: d.where(P.holds(p, {"o_orderstatus"})), ps, t.orders.alias("t0")).select("o_orderkey")


@query("OP022_scored_pairs", """WITH p AS (SELECT a.s_suppkey AS tid0, b.s_suppkey AS tid1 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND levenshtein(a.s_name, b.s_name) <= 2)
  SELECT tid0, tid1 FROM p""")  # fmt: skip
def _(t):
    s = t.supplier
    near = s.alias("x").join(s.alias("y"), (F.col("x.s_nationkey") == F.col("y.s_nationkey")) & (F.col("x.s_suppkey") < F.col("y.s_suppkey"))).where(S.levenshtein_column(F.col("x.s_name"), F.col("y.s_name")) <= 2)
    near = near.select(F.col("x.s_suppkey").alias("tid0"), F.col("y.s_suppkey").alias("tid1"))
    scored = P.parse("similar('levenshtein', supplier.t0.s_name, supplier.t1.s_name, 0.9)")
    return J.tuple_pairs(s, s, [C.equal("supplier", "s_nationkey"), scored], "s_suppkey", "s_suppkey", True, {str(scored): near})


@query("OP023_predicate_text")
def _(t):
    lines = ["orders.t0.o_custkey == orders.t1.o_custkey", "orders.t0.o_totalprice <= 100", "similar('cosine', part.t0.p_name, part.t1.p_name, 0.9)", "ML_ditto( part.t0.p_name , part.t1.p_name )"]
    return t.spark.createDataFrame([(x, str(P.parse(x))) for x in lines], "line string, printed string")


@query("OP025_blank_safe_indicator", """SELECT CAST(sum(CASE WHEN o_orderstatus IS NOT NULL AND o_orderstatus <> '' AND o_orderpriority IS NOT NULL AND o_orderpriority <> '' AND o_orderstatus < o_orderpriority THEN 1 ELSE 0 END) AS BIGINT) AS n FROM orders""")
def _(t):
    p = P.Predicate(P.Operand("orders", 0, "o_orderstatus"), "<", P.Operand("orders", 0, "o_orderpriority"))
    return t.orders.alias("t0").agg(F.sum(P.indicator(p, {"o_orderstatus", "o_orderpriority"})).alias("n"))


@query("OP026_constant_indicator", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders")
def _(t):
    return t.orders.alias("t0").select("o_orderkey", P.indicator(C.is_value("orders", "o_orderpriority", "1-URGENT"), {"o_orderpriority"}).alias("urgent"))


@query("OP028_useful_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return t.customer.select(*R.useful_columns(t.customer, skip=("c_name", "c_acctbal")))


@query("OP031_without_enumerations", "SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) > 3 GROUP BY 2 HAVING count(*) * 100.0 / (SELECT count(*) FROM orders) > 5")
def _(t):
    d = t.orders.select("o_orderstatus", "o_orderpriority")
    return R.without_enumerations(R.frequent_constants(d, d.columns, 5, 100), d, 3)


@query("OP032_valid_constants", "SELECT DISTINCT lang AS value FROM documents WHERE regexp_matches(lang, '[a-zA-Z0-9]')")
def _(t):
    extra = t.spark.createDataFrame([("",), ("--",), ("  ",)], "value string")
    return R.valid_constants(t.documents.select(F.col("lang").alias("value")).distinct().union(extra))


# ---------------------------------------------------------------- joins


@query("OP040_self_join_pairs", "SELECT a.o_orderkey AS tid0, b.o_orderkey AS tid1 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority WHERE a.o_orderkey <> b.o_orderkey")
def _(t):
    ps = [C.equal("orders", c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")]
    return J.tuple_pairs(t.orders, t.orders, ps, "o_orderkey", "o_orderkey", True)


@query("OP041_most_selective_first", "SELECT 'customer.t0.c_mktsegment == customer.t1.c_mktsegment' AS predicate, CAST(sum(n * n) AS BIGINT) AS support FROM (SELECT count(*) n FROM customer GROUP BY c_mktsegment) UNION ALL SELECT 'customer.t0.c_nationkey == customer.t1.c_nationkey', CAST(sum(n * n) AS BIGINT) FROM (SELECT count(*) n FROM customer GROUP BY c_nationkey)")
def _(t):
    found = J.most_selective({"customer": t.customer}, [C.equal("customer", "c_mktsegment"), C.equal("customer", "c_nationkey")])
    return t.spark.createDataFrame([(str(p), n) for p, n in found], "predicate string, support long")


@query("OP042_cross_relation_join", "SELECT c_custkey AS tid0, s_suppkey AS tid1 FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return J.tuple_pairs(t.customer, t.supplier, [C.equal("customer", "c_nationkey", "supplier", "s_nationkey"), C.is_value("customer", "c_mktsegment", "BUILDING")], "c_custkey", "s_suppkey")


@query("OP043_three_tuple_variables", "SELECT DISTINCT a.o_orderkey AS tid0, b.o_orderkey AS tid1 FROM orders a, orders b, customer c WHERE a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey AND b.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'")
def _(t):
    o = t.orders
    third = P.Predicate(P.Operand("orders", 1, "o_custkey"), "==", P.Operand("customer", 2, "c_custkey"))
    return J.chain([o, o, t.customer], ["o_orderkey", "o_orderkey", "c_custkey"], [C.equal("orders", "o_custkey"), C.equal("orders", "o_orderpriority"), third, C.is_value("customer", "c_mktsegment", "BUILDING", 2)])


@query("OP044_chain_projection", "SELECT DISTINCT s_suppkey AS tid0, p_partkey AS tid1 FROM supplier, lineitem, part WHERE s_suppkey = l_suppkey AND l_partkey = p_partkey AND p_brand = 'Brand#11'")
def _(t):
    ps = [P.Predicate(P.Operand("supplier", 0, "s_suppkey"), "==", P.Operand("lineitem", 1, "l_suppkey")), P.Predicate(P.Operand("lineitem", 1, "l_partkey"), "==", P.Operand("part", 2, "p_partkey")), C.is_value("part", "p_brand", "Brand#11", 2)]
    return J.chain([t.supplier, t.lineitem, t.part], ["s_suppkey", "l_orderkey", "p_partkey"], ps, (0, 2))


KEYS = [J.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), J.ForeignKey("orders", "o_custkey", "customer", "c_custkey"), J.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"), J.ForeignKey("nation", "n_regionkey", "region", "r_regionkey")]


@query("OP045_foreign_key_inner_join", """SELECT l_orderkey AS lineitem__l_orderkey, l_quantity AS lineitem__l_quantity, o_orderstatus AS orders__o_orderstatus, c_mktsegment AS customer__c_mktsegment, n_name AS nation__n_name, r_name AS region__r_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")  # fmt: skip
def _(t):
    path = ("lineitem", "orders", "customer", "nation", "region")
    return J.join_path({n: getattr(t, n) for n in path}, KEYS, path, "inner", {"lineitem": ["l_orderkey", "l_quantity"], "orders": ["o_orderstatus"], "customer": ["c_mktsegment"], "nation": ["n_name"], "region": ["r_name"]})


@query("OP046_foreign_key_full_outer_join", "SELECT c_custkey AS customer__c_custkey, n_nationkey AS nation__n_nationkey, r_regionkey AS region__r_regionkey FROM customer FULL JOIN nation ON c_nationkey = n_nationkey FULL JOIN region ON n_regionkey = r_regionkey")
def _(t):
    tables = {n: getattr(t, n) for n in ("customer", "nation", "region")}
    return J.join_graph(tables, KEYS, "customer", {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"})


@query("OP047_foreign_key_left_join", "SELECT c_custkey AS customer__c_custkey, o_orderkey AS orders__o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def _(t):
    return J.join_path({"customer": t.customer, "orders": t.orders}, KEYS, ("customer", "orders"), "left_outer", {"customer": ["c_custkey"], "orders": ["o_orderkey"]})


_STEPS = ", ".join(f"('{k.table}', '{k.other}')" for k in KEYS)


@query("OP048_foreign_key_paths", f"""WITH RECURSIVE s(a, b) AS (VALUES {_STEPS}), n AS (SELECT DISTINCT unnest([a, b]) AS v FROM s), p AS (SELECT [v] AS path FROM n UNION ALL SELECT list_append(path, b) FROM p JOIN s ON a = path[-1] WHERE len(path) < 4 AND NOT list_contains(path, b))
  SELECT array_to_string(path, ' > ') AS path, CAST(len(path) AS INTEGER) AS n_tables FROM p""")  # fmt: skip
def _(t):
    return t.spark.createDataFrame([(" > ".join(p), len(p)) for p in J.key_paths(KEYS, 4)], "path string, n_tables int")


@query("OP049_label_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    return J.labelled_rows(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("OP050_pairs_within_blocks", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def _(t):
    x, y = t.part.alias("x"), t.part.alias("y")
    return x.join(y, (F.col("x.p_brand") == F.col("y.p_brand")) & (F.col("x.p_size") == F.col("y.p_size")) & (F.col("x.p_partkey") < F.col("y.p_partkey"))).select(F.col("x.p_partkey").alias("a"), F.col("y.p_partkey").alias("b"))


_TOKENS = "SELECT DISTINCT item_id AS rid, unnest(string_split_regex(lower(text), '[\\s.,]+')) AS token FROM benchmark"
_BLOCKS = f"WITH t AS (SELECT * FROM ({_TOKENS}) WHERE token <> ''), n AS (SELECT count(DISTINCT rid) * 0.1 AS most FROM t), b AS (SELECT * FROM t WHERE length(token) >= 4 AND token IN (SELECT token FROM t GROUP BY token HAVING count(*) > 1 AND count(*) <= (SELECT most FROM n)))"


def _tokens(t):
    words = F.filter(F.split(F.lower("text"), r"[\s.,]+"), lambda w: w != "")
    return t.benchmark.select("item_id", F.explode(words).alias("token")).distinct()


@query("OP051_shared_blocks", f"{_BLOCKS} SELECT x.rid AS a, y.rid AS b, CAST(count(*) AS BIGINT) AS shared FROM b x JOIN b y ON x.token = y.token AND x.rid < y.rid GROUP BY 1, 2")
def _(t):
    return J.candidate_pairs(_tokens(t), "item_id", "token", 0.0).select("a", "b", "shared")


@query("OP052_joint_tuples", "SELECT c_nationkey, list_sort(list(s_suppkey)) AS partners, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT c_nationkey FROM customer) JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1")
def _(t):
    return J.joint_tuples(t.customer, "c_nationkey", t.supplier, "s_nationkey", "s_suppkey")


# ---------------------------------------------------------------- counting


@query("OP060_value_histograms", "SELECT 'o_orderstatus' AS name, o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2")
def _(t):
    return reduce(DataFrame.unionByName, [named(C.histogram(t.orders, c), c) for c in ("o_orderstatus", "o_orderpriority")])


@query("OP061_predicate_support", "SELECT CAST(count(*) AS BIGINT) AS support FROM customer, supplier WHERE c_nationkey = s_nationkey")
def _(t):
    return C.as_longs(C.predicate_support(t.customer, "c_nationkey", t.supplier, "s_nationkey"))


_PAIRS = "FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus WHERE a.o_orderkey <> b.o_orderkey"


@query("OP062_rule_support", f"""SELECT 'orders.t0.o_orderpriority == orders.t1.o_orderpriority' AS rhs, CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (a.o_orderpriority = b.o_orderpriority) AS BIGINT) AS support,
  CAST(count(DISTINCT a.o_orderkey) AS BIGINT) AS rows0, CAST(count(DISTINCT b.o_orderkey) AS BIGINT) AS rows1, round(count(*) FILTER (a.o_orderpriority = b.o_orderpriority) / count(*), 9) AS confidence,
  CAST(count(*) - count(*) FILTER (a.o_orderpriority = b.o_orderpriority) AS BIGINT) AS violations {_PAIRS}""")  # fmt: skip
def _(t):
    body = C.Body.of([C.equal("orders", "o_custkey"), C.equal("orders", "o_orderstatus")])
    return C.as_longs(C.with_confidence(C.count_rules(t.orders, body, [C.equal("orders", "o_orderpriority")])))


@query("OP063_many_heads_one_pass", """SELECT rhs, CAST(count(*) AS BIGINT) AS support FROM (SELECT unnest([CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 'orders.t0.o_orderstatus == orders.t1.o_orderstatus' END, CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 'orders.t0.o_orderpriority == orders.t1.o_orderpriority' END]) AS rhs
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey) WHERE rhs IS NOT NULL GROUP BY rhs""")  # fmt: skip
def _(t):
    return C.count_rules(t.orders, C.Body.of([C.equal("orders", "o_custkey")]), [C.equal("orders", "o_orderstatus"), C.equal("orders", "o_orderpriority")]).select("rhs", "support").transform(C.as_longs)


@query("OP064_constant_head", """WITH x AS (SELECT DISTINCT a.o_orderkey, a.o_orderpriority p FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O')
  SELECT CAST(count(*) FILTER (p = '1-URGENT') AS BIGINT) AS support, CAST(count(*) AS BIGINT) AS rows0 FROM x""")  # fmt: skip
def _(t):
    body = C.Body.of([C.equal("orders", "o_custkey"), C.is_value("orders", "o_orderstatus", "F"), C.is_value("orders", "o_orderstatus", "O", 1)])
    return C.count_rules(t.orders, body, [C.is_value("orders", "o_orderpriority", "1-URGENT")]).select("support", "rows0").transform(C.as_longs)


@query("OP065_one_sided_constants", "SELECT CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (a.o_orderpriority = b.o_orderpriority) AS BIGINT) AS support FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey AND a.o_orderstatus = 'F' AND b.o_orderpriority = '1-URGENT'")
def _(t):
    body = C.Body.of([C.equal("orders", "o_custkey"), C.is_value("orders", "o_orderstatus", "F"), C.is_value("orders", "o_orderpriority", "1-URGENT", 1)])
    return C.count_rules(t.orders, body, [C.equal("orders", "o_orderpriority")]).select("support_x", "support").transform(C.as_longs)


@query("OP066_cross_relation_rule", "SELECT CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (c_acctbal = s_acctbal) AS BIGINT) AS support, CAST(count(DISTINCT c_custkey) AS BIGINT) AS rows0, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS rows1 FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def _(t):
    return C.count_across(t.customer, t.supplier, C.Body.of([C.equal("customer", "c_nationkey", "supplier", "s_nationkey")]), [C.equal("customer", "c_acctbal", "supplier", "s_acctbal")]).select("support_x", "support", "rows0", "rows1").transform(C.as_longs)


@query("OP068_rows_with_partners", "SELECT CAST(count(DISTINCT a.event_id) AS BIGINT) AS rows0, CAST(count(DISTINCT b.event_id) AS BIGINT) AS rows1 FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_id <> b.event_id AND a.event_type = 'click'")
def _(t):
    body = C.Body.of([C.equal("events", "user_id"), C.is_value("events", "event_type", "click")])
    return C.count_rules(t.events, body, [C.equal("events", "event_type")]).select("rows0", "rows1").transform(C.as_longs)


@query("OP069_frequent_constants", """SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2 HAVING count(*) * 100.0 / (SELECT count(*) FROM orders) > 10 AND count(*) * 100.0 / (SELECT count(*) FROM orders) < 40
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2 HAVING count(*) * 100.0 / (SELECT count(*) FROM orders) > 10 AND count(*) * 100.0 / (SELECT count(*) FROM orders) < 40""")  # fmt: skip
def _(t):
    return R.frequent_constants(t.orders, ["o_orderpriority", "o_orderstatus"], 10, 40)


@query("OP070_constants_above", "SELECT p_size AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1 HAVING count(*) >= 40")
def _(t):
    return R.constants_above(t.part, "p_size", 40)


@query("OP071_column_statistics", """SELECT 'o_totalprice' AS "column", CAST(count(DISTINCT o_totalprice) AS BIGINT) AS n_distinct, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std, min(o_totalprice) AS least, max(o_totalprice) AS largest FROM orders
  UNION ALL SELECT 'o_orderstatus', CAST(count(DISTINCT o_orderstatus) AS BIGINT), NULL, NULL, NULL, NULL FROM orders""")  # fmt: skip
def _(t):
    return R.column_stats(t.orders, ["o_totalprice", "o_orderstatus"])


@query("OP072_multiset_overlap", "WITH a AS (SELECT c_nationkey v, count(*) n FROM customer GROUP BY 1), b AS (SELECT s_nationkey v, count(*) m FROM supplier GROUP BY 1) SELECT round(sum(least(n, coalesce(m, 0))) / sum(greatest(n, coalesce(m, 0))), 9) AS overlap FROM a LEFT JOIN b USING (v)")
def _(t):
    return R.overlap(t.customer, "c_nationkey", t.supplier, "s_nationkey")


@query("OP073_few_rows", "SELECT 'r_name' AS \"column\", count(r_name) <= 5 AS few FROM region UNION ALL SELECT 'r_regionkey', count(r_regionkey) <= 5 FROM region")
def _(t):
    return R.few_values(t.region, ["r_name", "r_regionkey"])


@query("OP074b_ranges_of_clusters", """SELECT 'p_brand' AS "column", p_brand AS cluster, min(p_size) AS least, max(p_size) AS largest, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 2""")
def _(t):
    return R.cluster_ranges(t.part, "p_brand", ["p_size"]).select(F.lit("p_brand").alias("column"), F.col("p_brand").alias("cluster"), F.col("least_p_size").alias("least"), F.col("largest_p_size").alias("largest"), "n")


@query("OP074_shared_cardinality", "SELECT CAST(count(*) AS BIGINT) AS pairs FROM part, lineitem WHERE p_size = l_quantity")
def _(t):
    return C.as_longs(R.shared_pairs(t.part.select(F.col("p_size").cast("double").alias("p_size")), "p_size", t.lineitem, "l_quantity"))


@query("OP075_evidence_sets", "SELECT CAST((CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 1 ELSE 0 END) + (CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 2 ELSE 0 END) AS INTEGER) AS mask, CAST(count(*) AS BIGINT) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey GROUP BY 1")
def _(t):
    return R.evidence(t.orders, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_custkey")


@query("OP076_null_patterns")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").select("quality", "toxic", "lang")
    return R.null_patterns(d, ["quality", "toxic", "lang"])


@query("OP077_frequent_tokens", "SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents) WHERE token <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 100")
def _(t):
    return T.frequent_tokens(t.documents, F.filter(F.split(F.lower("text"), "[ \\t\\n\\f\\r\\x0B]+"), lambda w: w != ""), 100)


@query("OP082_sorted_dictionary", "SELECT p_brand AS value, CAST(dense_rank() OVER (ORDER BY p_brand) AS BIGINT) AS code FROM part GROUP BY p_brand")
def _(t):
    return R.sorted_dictionary(t.part, "p_brand")


@query("OP090_union_of_constants", "SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 2 HAVING count(*) > 0 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), CAST(count(*) AS BIGINT) FROM customer GROUP BY 2")
def _(t):
    return R.frequent_constants(t.customer, ["c_mktsegment", "c_nationkey"], 0, 101)


# ---------------------------------------------------------------- similarity

#: Pairs of distinct names that share a gram of two characters: all that any of the measures finds alike.
_NAMES = """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS s FROM part), g AS (SELECT DISTINCT s, unnest([substr(s, CAST(i AS INTEGER), 2) FOR i IN range(1, length(s))]) AS gram FROM n),
  p AS (SELECT DISTINCT x.s AS a, y.s AS b FROM g x JOIN g y ON x.gram = y.gram AND x.s < y.s)"""


def _names(t):
    n = t.part.select(F.col("p_name").alias("s")).distinct()
    grams = n.select("s", F.explode(F.array_distinct(S.shingles(F.col("s"), 2))).alias("gram"))
    x, y = grams.select(F.col("s").alias("a"), "gram"), grams.select(F.col("s").alias("b"), "gram")
    return x.join(y, "gram").where("a < b").select("a", "b").distinct()


def _table_sql(start: str, cell: str) -> str:
    """SQL of a distance by its dynamic program, a row of the table at a time.  `start` is the row of no
    characters of a; `cell` the value at place j before insertions (j - k each) are weighed, from r (the row before),
    rr (the one before that), x = a's i-th character."""
    return f"""{_NAMES}, d AS (SELECT a, b, 0 AS i, {start} AS r, {start} AS rr FROM p
  UNION ALL SELECT a, b, i + 1, [list_min([(CASE WHEN k = 0 THEN i + 1.0 ELSE {cell} END) + (j - k) FOR k IN range(0, j + 1)]) FOR j IN range(0, length(b) + 1)], r FROM d WHERE i < length(a))"""


#: Characters are counted from 1, places of rows from 0; k is a place of b.
_SAME = "(CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(k AS INTEGER), 1) THEN 0 ELSE 1 END)"
_START = "[CAST(j AS DOUBLE) FOR j IN range(0, length(b) + 1)]"
#: Edits without replacement: the distance by the longest common subsequence.
_LCS = _table_sql(_START, f"least(r[k + 1] + 1, r[k] + 2 * {_SAME})")
_OSA = _table_sql(_START, f"least(r[k + 1] + 1, r[k] + {_SAME}, CASE WHEN i > 0 AND k > 1 AND substr(a, i + 1, 1) = substr(b, CAST(k AS INTEGER) - 1, 1) AND substr(a, i, 1) = substr(b, CAST(k AS INTEGER), 1) THEN rr[k - 1] + {_SAME} ELSE 1e9 END)")
#: Grams of two: the first one begins with padding, which agrees and weighs nothing.
_GRAM = """(CASE WHEN i = 0 AND k = 1 THEN (CASE WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 0.0 ELSE 1.0 END)
  ELSE ((CASE WHEN i > 0 AND k > 1 AND substr(a, i, 1) = substr(b, CAST(k AS INTEGER) - 1, 1) THEN 0 ELSE 1 END) + (CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(k AS INTEGER), 1) THEN 0 ELSE 1 END)) / 2.0 END)"""
_NGRAM = _table_sql(_START, f"least(r[k + 1] + 1, r[k] + {_GRAM})")
_LAST = "r[length(b) + 1]"
_PREFIX = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, CAST(i AS INTEGER)) = substr(b, 1, CAST(i AS INTEGER))))"


def _shingle_sql(k: int) -> str:
    own = f"[substr({{0}}, CAST(i AS INTEGER), {k}) FOR i IN range(1, length({{0}}) - {k} + 2)]"
    return f"{_NAMES}, q AS (SELECT a, b, {own.format('a')} AS xs, {own.format('b')} AS ys FROM p), z AS (SELECT a, b, xs, ys, list_distinct(xs) AS x, list_distinct(ys) AS y FROM q)"


_MET = {
    "OP100_cosine": ("cosine", lambda: S.cosine_column(F.col("a"), F.col("b"), 2), f"{_shingle_sql(2)} SELECT a, b, round(list_sum([len(list_filter(xs, lambda v: v = s)) * len(list_filter(ys, lambda v: v = s)) FOR s IN list_intersect(x, y)]) / sqrt(list_sum([len(list_filter(xs, lambda v: v = s)) ** 2 FOR s IN x])) / sqrt(list_sum([len(list_filter(ys, lambda v: v = s)) ** 2 FOR s IN y])), 9) AS measure FROM z"),
    "OP101_damerau": ("damerau", lambda: S.metric("damerau")(F.col("a"), F.col("b")), f"{_NAMES} SELECT a, b, CAST(damerau_levenshtein(a, b) AS DOUBLE) AS measure FROM p"),
    "OP102_jaccard": ("jaccard", lambda: S.jaccard_column(F.col("a"), F.col("b"), 2), f"{_shingle_sql(2)} SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS measure FROM z"),
    "OP103_jaro_winkler": ("jaro_winkler", lambda: S.metric("jaro_winkler")(F.col("a"), F.col("b")), f"{_NAMES}, j AS (SELECT a, b, jaro_similarity(a, b) AS j FROM p) SELECT a, b, round(CASE WHEN j > 0.7 THEN j + least(0.1, 1.0 / greatest(length(a), length(b))) * {_PREFIX} * (1 - j) ELSE j END, 9) AS measure FROM j"),
    "OP104_levenshtein": ("levenshtein", lambda: S.levenshtein_column(F.col("a"), F.col("b")).cast("double"), f"{_NAMES} SELECT a, b, CAST(levenshtein(a, b) AS DOUBLE) AS measure FROM p"),
    "OP105_lcs": ("lcs", lambda: S.metric("lcs_distance")(F.col("a"), F.col("b")), f"{_LCS} SELECT a, b, {_LAST} AS measure FROM d WHERE i = length(a)"),
    "OP106_metric_lcs": ("metric_lcs", lambda: S.metric("metric_lcs")(F.col("a"), F.col("b")), f"{_LCS} SELECT a, b, round(1 - (length(a) + length(b) - {_LAST}) / 2 / greatest(length(a), length(b)), 9) AS measure FROM d WHERE i = length(a)"),
    "OP107_ngram": ("ngram", lambda: S.metric("ngram_distance")(F.col("a"), F.col("b")), f"{_NGRAM} SELECT a, b, round({_LAST} / greatest(length(a), length(b)), 9) AS measure FROM d WHERE i = length(a)"),
    "OP108_normalized_levenshtein": ("nl", lambda: S.normalized_levenshtein_column(F.col("a"), F.col("b")), f"{_NAMES} SELECT a, b, round(levenshtein(a, b) / greatest(length(a), length(b)), 9) AS measure FROM p"),
    "OP109_optimal_string_alignment": ("osa", lambda: S.metric("optimal_string_alignment")(F.col("a"), F.col("b")), f"{_OSA} SELECT a, b, {_LAST} AS measure FROM d WHERE i = length(a)"),
    "OP110_overlap_coefficient": ("overlap", lambda: S.overlap_column(F.col("a"), F.col("b"), 3), f"{_shingle_sql(3)} SELECT a, b, round(len(list_intersect(x, y)) / least(len(x), len(y)), 9) AS measure FROM z"),
    "OP111_qgram": ("qgram", lambda: S.qgram_column(F.col("a"), F.col("b"), 2).cast("double"), f"{_shingle_sql(2)} SELECT a, b, CAST(list_sum([abs(len(list_filter(xs, lambda v: v = s)) - len(list_filter(ys, lambda v: v = s))) FOR s IN list_distinct(list_concat(x, y))]) AS DOUBLE) AS measure FROM z"),
    "OP113_sorensen_dice": ("dice", lambda: S.dice_column(F.col("a"), F.col("b"), 2), f"{_shingle_sql(2)} SELECT a, b, round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS measure FROM z"),
    "OP114_weighted_levenshtein": ("wl", lambda: S.metric("weighted_levenshtein")(F.col("a"), F.col("b")), f"{_NAMES} SELECT a, b, CAST(levenshtein(a, b) AS DOUBLE) AS measure FROM p"),
    "OP115_sift4": ("sift4", lambda: S.metric("sift4")(F.col("a"), F.col("b")), None),
}
for _name, (_, _make, _sql_text) in _MET.items():
    query(_name, _sql_text)(lambda t, make=_make: _names(t).select("a", "b", F.round(make(), 9).alias("measure")))


@query("OP116_sixteen_measures")
def _(t):
    return _names(t).select("a", "b", S.vector(16)(F.col("a"), F.col("b")).alias("similarities"))


@query("OP117_refined_measures", f"{_LCS} SELECT a, b, CAST(-levenshtein(a, b) AS DOUBLE) AS edit, -{_LAST} AS lcs FROM d WHERE i = length(a)")
def _(t):
    both = S.vector(2)(F.col("a"), F.col("b"))
    return _names(t).select("a", "b", both.alias("m")).select("a", "b", F.col("m")[0].alias("edit"), F.col("m")[1].alias("lcs"))


@query("OP117b_measures_of_tokens")
def _(t):
    words = lambda c: F.split(c, " ")
    return _names(t).select("a", "b", S.token_vector()(words(F.col("a")), words(F.col("b"))).alias("similarities"))


@query("OP118_fifteen_measures")
def _(t):
    return _names(t).select("a", "b", S.vector(15)(F.col("a"), F.col("b")).alias("measures"))


# ---------------------------------------------------------------- text


@query("OP120_clean_sentence", "SELECT item_id, trim(regexp_replace(replace(regexp_replace(lower(text), '[\\n\\t]', '', 'g'), ' - ', '-'), '([-/+^*÷#!\"(),.:;<=>?@\\[\\\\\\]_`{|}~''¿€$%&£±])', ' \\1 ', 'g')) AS cleaned FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", T.clean_sentence(F.col("text")).alias("cleaned"))


@query("OP121_remove_signs", "SELECT c_custkey, regexp_replace(c_name || ' 12-34 x.y', '([0-9]+[^\\x{4e00}-\\x{9fff}0-9a-zA-Z]+[0-9]+)|[^\\x{4e00}-\\x{9fff}0-9a-zA-Z]+', '\\1', 'g') AS cleaned FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.remove_signs(F.concat("c_name", F.lit(" 12-34 x.y"))).alias("cleaned"))


@query("OP122_remove_words", "SELECT n_nationkey, replace(replace(n_name || '深圳市福田区', '福田区', ''), '深圳市', '') AS cleaned FROM nation")
def _(t):
    return t.nation.select("n_nationkey", T.remove_words(F.concat("n_name", F.lit("深圳市福田区"))).alias("cleaned"))


@query("OP123_remove_asides", "SELECT n_nationkey, n_name || ' ' || ' x' AS cleaned FROM nation")
def _(t):
    return t.nation.select("n_nationkey", T.remove_asides(F.concat("n_name", F.lit(" (left out)13800138000 x"))).alias("cleaned"))


@query("OP124_plain_digits", "SELECT r_regionkey, translate(r_name || '二〇两', '二〇两', '202') AS cleaned FROM region")
def _(t):
    return t.region.select("r_regionkey", T.plain_digits(F.concat("r_name", F.lit("二〇两"))).alias("cleaned"))


@query("OP125_letters_digits", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS letters, array_to_string(list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda r: length(r) > 0 AND length(r) < 8), '-') AS codes FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.letters_digits(F.lower("c_name")).alias("letters"), T.short_codes(F.lower("c_name")).alias("codes"))


@query("OP126_codes_around_words", "SELECT c_custkey, regexp_extract(lower(c_name), '([a-z0-9]*)$', 1) AS last, CASE WHEN contains(lower(c_name), '#') THEN regexp_extract(split_part(lower(c_name), '#', 1), '([a-z0-9]*)$', 1) ELSE '' END AS before FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.last_code(F.lower("c_name")).alias("last"), T.code_before(F.lower("c_name"), "#").alias("before"))


@query("OP127_grams_and_words", "SELECT p_partkey, [substr(p_name, CAST(i AS INTEGER), 3) FOR i IN range(1, length(p_name) - 1)] AS grams, string_split(p_name, ' ') AS words FROM part")
def _(t):
    return t.part.select("p_partkey", T.grams(F.col("p_name"), 3).alias("grams"), T.split_words(F.col("p_name")).alias("words"))


@query("OP129_joined_columns", "SELECT c_custkey, concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment) AS line FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.joined_columns(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).alias("line"))


@query("OP130_leave_one_out", "SELECT p_partkey, concat_ws(' ', p_brand, p_type) AS without_p_name, concat_ws(' ', p_name, p_type) AS without_p_brand, concat_ws(' ', p_name, p_brand) AS without_p_type FROM part")
def _(t):
    return T.leave_one_out(t.part, ["p_name", "p_brand", "p_type"]).select("p_partkey", "without_p_name", "without_p_brand", "without_p_type")


@query("OP131_useful_keywords", """WITH k AS (SELECT unnest(['e', 'ion', 'zz']) AS keyword), r AS (SELECT keyword, count(*) FILTER (instr(lower(p_type), keyword) > 0) AS n, count(*) FILTER (instr(lower(p_type), keyword) > 1 AND regexp_matches(substr(lower(p_type), CAST(instr(lower(p_type), keyword) AS INTEGER) - 1, 1), '[a-z0-9]')) AS before FROM part, k GROUP BY 1)
  SELECT keyword, CAST(n AS BIGINT) AS n, CAST(before AS BIGINT) AS before FROM r WHERE n > 0 AND before >= 0.5 * n""")  # fmt: skip
def _(t):
    return T.useful_keywords(t.part, F.lower("p_type"), ["e", "ion", "zz"])


# ---------------------------------------------------------------- rules


@query("OP141_joinable_columns", "WITH a AS (SELECT c_nationkey v, count(*) n FROM customer GROUP BY 1), b AS (SELECT n_nationkey v, count(*) m FROM nation GROUP BY 1), o AS (SELECT round(sum(least(n, coalesce(m, 0))) / sum(greatest(n, coalesce(m, 0))), 9) AS overlap FROM a LEFT JOIN b USING (v)) SELECT overlap, overlap > 0.3 AS joinable FROM o")
def _(t):
    return R.joinable(t.customer, "c_nationkey", t.nation, "n_nationkey")


@query("OP142_comparable_columns", """WITH s AS (SELECT avg(c_acctbal) m1, stddev_pop(c_acctbal) s1 FROM customer), u AS (SELECT avg(s_acctbal) m2, stddev_pop(s_acctbal) s2 FROM supplier), r AS (SELECT round(least(abs(m1), abs(m2)) / greatest(abs(m1), abs(m2)), 9) AS mean_ratio, round(least(s1, s2) / greatest(s1, s2), 9) AS std_ratio FROM s, u)
  SELECT mean_ratio, std_ratio, mean_ratio > 0.3 AND std_ratio > 0.3 AS comparable FROM r""")  # fmt: skip
def _(t):
    return R.comparable(t.customer, "c_acctbal", t.supplier, "s_acctbal")


@query("OP143b_predicate_space")
def _(t):
    found = P.column_predicates("part", {"p_brand": "text", "p_size": "number"}, ordered=True) + P.constant_predicates("part", {"p_brand": ["Brand#11"]}, ordered=True)
    return t.spark.createDataFrame([(i, str(p), str(p.inverse()), str(p.symmetric())) for i, p in enumerate(found)], "number int, predicate string, inverse string, symmetric string")


# ---------------------------------------------------------------- the search, and all candidates by SQL


def every_candidate(table: str, columns: list[str], constants: dict[str, list], levels: int) -> tuple[str, int]:
    """SQL for the counts of all candidates (X, right-hand side) of a search over one table: mask, lhs, rhs, level,
    support_x, support, confidence (CTE `c`), n (its rows).  X holds equalities of columns and constants; each
    candidate is counted by its own grouping."""
    from itertools import combinations

    pairs = [C.equal(table, c) for c in columns]
    fixed = P.constant_predicates(table, constants)
    every = pairs + [p for p in fixed if p.op == "=="]
    parts = []
    for size in range(1, levels + 1):
        for lhs in combinations(every, size):
            if not any(p.right for p in lhs) or not D.compatible(frozenset(lhs)):
                continue
            mask = sum(1 << every.index(p) for p in lhs)
            keys = [p.left.column for p in lhs if p.right]
            meets = lambda v, lhs=lhs: " AND ".join([f"{p.left.column} = '{p.constant}'" for p in lhs if p.is_constant and p.left.variable == v]) or "true"
            pairs_of = lambda by, meets=meets: f"(SELECT coalesce(sum(n0 * n1 - nb), 0) FROM (SELECT count(*) FILTER ({meets(0)}) AS n0, count(*) FILTER ({meets(1)}) AS n1, count(*) FILTER ({meets(0)} AND {meets(1)}) AS nb FROM {table} GROUP BY {', '.join(by)}))"
            texts = ", ".join("'" + str(p).replace("'", "''") + "'" for p in sorted(lhs, key=str))
            for rhs in pairs:
                if rhs not in lhs:
                    parts.append(f"SELECT {mask} AS mask, [{texts}] AS lhs, '{rhs}' AS rhs, {size} AS level, {pairs_of(keys)} AS support_x, {pairs_of([*keys, rhs.left.column])} AS support")
    return f"WITH z AS ({' UNION ALL '.join(parts)}), c AS (SELECT mask, lhs, rhs, level, CAST(support_x AS BIGINT) AS support_x, CAST(support AS BIGINT) AS support, CASE WHEN support_x > 0 THEN round(support / support_x, 9) ELSE 0.0 END AS confidence, (SELECT count(*) FROM {table}) AS n FROM z)", len(every)


def minimal_rules(candidates: str, support: int, confidence: float) -> str:
    """CTE `r` over `c`: the valid candidates without a valid one inside."""
    return f"{candidates}, v AS (SELECT *, round(0.4 * support / n / sqrt(n) + 0.2 * confidence + 0.2 / (100 + 1e-5) + 0.1 / level, 9) AS score FROM c WHERE support >= {support} AND confidence >= {confidence}), r AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.rhs = v.rhs AND w.mask <> v.mask AND (w.mask & v.mask) = w.mask))"


_ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority"]
_ORDER_CONSTANTS = {"o_orderstatus": ["F", "O"]}
_ORDER_RULES = minimal_rules(every_candidate("orders", _ORDER_COLUMNS, _ORDER_CONSTANTS, 3)[0], 100, 0.19)
_RULE = "lhs, rhs, CAST(level AS INTEGER) AS level, support, confidence, score"
#: The line of a rule, as its text form has it.
_LINE = "'Rule : [REE: orders ^ orders ^ ' || array_to_string(lhs, '  ') || ' -> ' || rhs || '], supp: ' || support || ', conf:' || format('{:.9g}', confidence)"


def _rules(t, **options):
    return D.discover(t.orders, "orders", _ORDER_COLUMNS, constants=_ORDER_CONSTANTS, support=100, confidence=0.19, levels=3, **options)


def _as_rows(t, rules):
    return U.as_table(t.spark, rules).drop("rule")


@query("OP167_discover_rules", f"{_ORDER_RULES} SELECT {_RULE} FROM r")
def _(t):
    return _as_rows(t, _rules(t))


@query("OP080_top_rules", f"{_ORDER_RULES} SELECT {_RULE} FROM r ORDER BY score DESC, {_LINE} LIMIT 5")
def _(t):
    return _as_rows(t, _rules(t, top=5))


_TWO_TABLES = [C.equal("customer", "c_nationkey"), C.equal("customer", "c_mktsegment"), C.equal("customer", "c_nationkey", "supplier", "s_nationkey"), P.parse("customer.t0.c_acctbal <= supplier.t1.s_acctbal")]


def _joined_sql(condition: str, head: str, lhs: list[str], rhs: str, tables: str = "customer a, supplier b", row: str = "a.c_custkey", hit: str = "count(*)") -> str:
    texts = ", ".join(f"'{x}'" for x in lhs)
    return f"SELECT [{texts}] AS lhs, '{rhs}' AS rhs, CAST(count(*) AS BIGINT) AS support_x, CAST({hit} FILTER ({head}) AS BIGINT) AS support FROM {tables} WHERE {condition}"


_NATION, _BALANCE, _SEGMENT = (str(p) for p in (_TWO_TABLES[2], _TWO_TABLES[3], _TWO_TABLES[1]))


@query("OP167b_rules_over_two_tables", " UNION ALL ".join([
    _joined_sql("a.c_nationkey = b.s_nationkey", "a.c_acctbal <= b.s_acctbal", [_NATION], _BALANCE), _joined_sql("a.c_acctbal <= b.s_acctbal", "a.c_nationkey = b.s_nationkey", [_BALANCE], _NATION),
    _joined_sql("a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey", "a.c_mktsegment = b.c_mktsegment", [str(_TWO_TABLES[0])], _SEGMENT, "customer a, customer b"),
    _joined_sql("a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey", "a.c_nationkey = b.c_nationkey", [_SEGMENT], str(_TWO_TABLES[0]), "customer a, customer b")]))
def _(t):
    source = D.Source({"customer": t.customer, "supplier": t.supplier}, {"customer": "c_custkey", "supplier": "s_suppkey"})
    found = D.mine(source, _TWO_TABLES, [], _TWO_TABLES, 1, 1.1, 1)
    return t.spark.createDataFrame([(sorted(map(str, x)), str(y), c["support_x"], c["support"]) for x, y, c in found.counted], "lhs array<string>, rhs string, support_x long, support long")


_NEAR = P.parse("similar('levenshtein', supplier.t0.s_name, supplier.t1.s_name, 0.9)")
_NEAR_SQL = "a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND levenshtein(a.s_name, b.s_name) <= 2"


@query("OP167c_scored_and_ordered_rules", " UNION ALL ".join([
    _joined_sql(_NEAR_SQL, "a.s_acctbal < b.s_acctbal", [str(_NEAR).replace("'", "''")], "supplier.t0.s_acctbal < supplier.t1.s_acctbal", "supplier a, supplier b"), _joined_sql(_NEAR_SQL, "a.s_nationkey = b.s_nationkey", [str(_NEAR).replace("'", "''")], "supplier.t0.s_nationkey == supplier.t1.s_nationkey", "supplier a, supplier b"),
    _joined_sql(_NEAR_SQL + " AND a.s_acctbal < b.s_acctbal", "a.s_nationkey = b.s_nationkey", [str(_NEAR).replace("'", "''"), "supplier.t0.s_acctbal < supplier.t1.s_acctbal"], "supplier.t0.s_nationkey == supplier.t1.s_nationkey", "supplier a, supplier b")]))
def _(t):
    s = t.supplier
    near = s.alias("x").join(s.alias("y"), (F.col("x.s_nationkey") == F.col("y.s_nationkey")) & (F.col("x.s_suppkey") < F.col("y.s_suppkey"))).where(S.levenshtein_column(F.col("x.s_name"), F.col("y.s_name")) <= 2)
    source = D.Source({"supplier": s}, {"supplier": "s_suppkey"}, {str(_NEAR): near.select(F.col("x.s_suppkey").alias("tid0"), F.col("y.s_suppkey").alias("tid1"))})
    nation, less = C.equal("supplier", "s_nationkey"), P.parse("supplier.t0.s_acctbal < supplier.t1.s_acctbal")
    found = D.mine(source, [_NEAR, less], [], [nation, less], 0, 1.1, 2)
    return t.spark.createDataFrame([(sorted(map(str, x)), str(y), c["support_x"], c["support"]) for x, y, c in found.counted if _NEAR in x], "lhs array<string>, rhs string, support_x long, support long")


_CHAIN_LHS = ["supplier.t0.s_nationkey == customer.t1.c_nationkey"]


@query("OP154_third_tuple_variable", """WITH p AS (SELECT DISTINCT s_suppkey, c_custkey, s_acctbal, c_acctbal FROM supplier JOIN customer ON s_nationkey = c_nationkey),
  e AS (SELECT 'supplier.t0.s_nationkey == customer.t2.c_nationkey' AS edge, (SELECT count(*) FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = a.s_nationkey AND c.c_custkey <> b.c_custkey)) AS n
    UNION ALL SELECT 'customer.t1.c_nationkey == supplier.t2.s_nationkey', (SELECT count(*) FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey WHERE EXISTS (SELECT 1 FROM supplier c WHERE c.s_nationkey = b.c_nationkey AND c.s_suppkey <> a.s_suppkey)))
  SELECT list_sort(['supplier.t0.s_nationkey == customer.t1.c_nationkey', edge]) AS lhs, CAST(n AS BIGINT) AS support_x FROM e""")  # fmt: skip
def _(t):
    edge, head = P.parse(_CHAIN_LHS[0]), P.parse("supplier.t0.s_acctbal < customer.t1.c_acctbal")
    source = D.Source({"supplier": t.supplier, "customer": t.customer}, {"supplier": "s_suppkey", "customer": "c_custkey"})
    found = D.mine(source, [edge], [], [head], 0, 1.1, 2, variables=3)
    return t.spark.createDataFrame([(sorted(map(str, x)), c["support_x"]) for x, _, c in found.counted if len(x) == 2], "lhs array<string>, support_x long")


@query("OP092_rule_difference")
def _(t):
    sample = A.uniform(t.orders, 0.3, "o_orderkey", seed=7)
    some = D.discover_table(sample, "orders", _ORDER_COLUMNS, support=10, confidence=0.19, levels=2)
    return U.compare(some, U.as_table(t.spark, _rules(t)))


_COMBOS = [([], "o_orderstatus"), (["o_custkey"], "o_orderstatus"), (["o_custkey"], "o_orderpriority"), (["o_custkey", "o_orderstatus"], "o_orderpriority")]


@query("OP165_given_rules", " UNION ALL ".join(
    f"SELECT {i} AS rule, CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (a.{y} = b.{y}) AS BIGINT) AS support, round(count(*) FILTER (a.{y} = b.{y}) / count(*), 9) AS confidence FROM orders a JOIN orders b ON {' AND '.join(f'a.{c} = b.{c}' for c in x)} AND a.o_orderkey <> b.o_orderkey"
    for i, (x, y) in enumerate(_COMBOS[1:])))
def _(t):
    rules = [([C.equal("orders", c) for c in x], C.equal("orders", y)) for x, y in _COMBOS[1:]]
    return D.evaluate(t.orders, rules).select("rule", "support_x", "support", "confidence")


@query("OP170_interestingness", "WITH n AS (SELECT count(*) AS n FROM orders), g AS (SELECT count(*) AS m FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority), x AS (SELECT count(*) AS m FROM orders GROUP BY o_custkey, o_orderstatus), s AS (SELECT (SELECT sum(m * (m - 1)) FROM g) AS supp, (SELECT sum(m * (m - 1)) FROM x) AS suppx) SELECT round(0.4 * supp / n / sqrt(n) + 0.2 * round(supp / suppx, 9) + 0.2 / (100 + 1e-5) + 0.1 / 2, 9) AS score FROM s, n")
def _(t):
    n = t.orders.count()
    row = D.evaluate(t.orders, [([C.equal("orders", "o_custkey"), C.equal("orders", "o_orderstatus")], C.equal("orders", "o_orderpriority"))]).first()
    rule = U.Rule.of([C.equal("orders", "o_custkey"), C.equal("orders", "o_orderstatus")], C.equal("orders", "o_orderpriority"), support=row.support, confidence=row.confidence)
    return t.spark.createDataFrame([(round(D.Interest(n).score(rule), 9),)], "score double")


@query("OP172_recovered_constants", """WITH p AS (SELECT a.o_orderstatus AS c0_o_orderstatus, b.o_orderstatus AS c1_o_orderstatus, a.o_orderpriority = b.o_orderpriority AS eq FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey)
  SELECT c0_o_orderstatus, c1_o_orderstatus, CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (eq) AS BIGINT) AS support, round(count(*) FILTER (eq) / count(*), 9) AS confidence FROM p GROUP BY 1, 2 HAVING count(*) FILTER (eq) >= 50 AND round(count(*) FILTER (eq) / count(*), 9) >= 0.1""")  # fmt: skip
def _(t):
    return C.as_longs(D.recover(t.orders, ["o_custkey"], ["o_orderstatus"], ["o_orderstatus"], "o_orderpriority", 50, 0.1))


@query("OP173_recovered_head_constants", """WITH r AS (SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)), c AS (SELECT o_orderstatus, o_orderpriority AS value, count(*) AS support FROM r GROUP BY 1, 2), k AS (SELECT *, sum(support) OVER (PARTITION BY o_orderstatus) AS rows0, row_number() OVER (PARTITION BY o_orderstatus ORDER BY support DESC, value) AS rn FROM c)
  SELECT o_orderstatus AS c0_o_orderstatus, value, CAST(support AS BIGINT) AS support, CAST(rows0 AS BIGINT) AS rows0, round(support / rows0, 9) AS confidence FROM k WHERE rn = 1 AND support >= 10 AND support / rows0 >= 0.1""")  # fmt: skip
def _(t):
    return D.recover_head(t.orders, ["o_custkey"], ["o_orderstatus"], "o_orderpriority", 10, 0.1)


@query("OP176_rules_by_number", "SELECT 0 AS rule, CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (a.c_mktsegment = b.c_mktsegment) AS BIGINT) AS support FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey")
def _(t):
    words = [C.equal("customer", "c_nationkey"), C.equal("customer", "c_mktsegment")]
    return D.evaluate_ids(t.customer, words, "0,1").select("rule", "support_x", "support")


@query("OP177_column_association", "SELECT CAST(count(*) AS BIGINT) AS support_x, CAST(count(*) FILTER (a.p_type = b.p_type) AS BIGINT) AS support, round(count(*) FILTER (a.p_type = b.p_type) / count(*), 9) AS confidence FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def _(t):
    return C.as_longs(C.column_association(t.part, ["p_brand"], "p_type"))


_AS_SQL = "[regexp_replace(replace(replace(x, 'orders.', ''), ' == ', ' = '), '^(t[01][.]\\w+) = (\\w+)$', '\\1 = ''\\2''') FOR x IN {}]"
_PAIR_IDS = "SELECT t0.o_orderkey AS tid0, t1.o_orderkey AS tid1"
_WHERE = f"' FROM orders t0, orders t1 WHERE ' || array_to_string({_AS_SQL.format('lhs')}, ' AND ') || ' AND t0.o_orderkey <> t1.o_orderkey AND NOT coalesce(' || array_to_string({_AS_SQL.format('[rhs]')}, '') || ', false)'"


@query("OP178_rule_texts", f"""{_ORDER_RULES} SELECT {_LINE} AS rule, '{_PAIR_IDS}' || {_WHERE} AS check_sql,
  '{_PAIR_IDS}, t0.' || regexp_extract(rhs, 't0[.](\\w+)', 1) || ' AS found, t1.' || regexp_extract(rhs, 't1[.](\\w+)', 1) || ' AS wanted' || {_WHERE} AS correct_sql FROM r""")  # fmt: skip
def _(t):
    rules = _rules(t)
    return t.spark.createDataFrame([(str(r), r.check_sql("o_orderkey"), r.correct_sql("o_orderkey")) for r in rules], "rule string, check_sql string, correct_sql string")


@query("OP179_violations", "SELECT a.o_orderkey AS tid0, b.o_orderkey AS tid1 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus WHERE a.o_orderkey <> b.o_orderkey AND NOT coalesce(a.o_orderpriority = b.o_orderpriority, false)")
def _(t):
    return U.violating_pairs(t.orders, [C.equal("orders", "o_custkey"), C.equal("orders", "o_orderstatus")], C.equal("orders", "o_orderpriority"), "o_orderkey")


@query("OP179b_violating_groups", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS n_values, CAST((SELECT count(*) FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey WHERE x.c_mktsegment <> y.c_mktsegment AND x.c_nationkey = c.c_nationkey) AS BIGINT) AS conflicts FROM customer c GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def _(t):
    return C.as_longs(U.violating_groups(t.customer, ["c_nationkey"], "c_mktsegment"))


@query("OP180_entity_ids", """WITH RECURSIVE e AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 2000), r AS (SELECT x AS node, x AS near FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.near = e.x)
  SELECT node, min(near) AS eid FROM r GROUP BY node""")  # fmt: skip
def _(t):
    x, y = t.supplier.alias("x"), t.supplier.alias("y")
    pairs = x.join(y, (F.col("x.s_nationkey") == F.col("y.s_nationkey")) & (F.col("x.s_suppkey") < F.col("y.s_suppkey"))).where(F.abs(F.col("x.s_acctbal") - F.col("y.s_acctbal")) < 2000)
    return M.entity_ids(pairs.select(F.col("x.s_suppkey").alias("a"), F.col("y.s_suppkey").alias("b")), "a", "b")


@query("OP184_numeric_constants")
def _(t):
    return R.numeric_constants(t.part, "p_retailprice")


# ---------------------------------------------------------------- samples and matching


@query("OP190_uniform_sample", """WITH d AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5('1:' || o_orderkey), 1, 13) AS BIGINT), o_orderkey) AS r, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, o_custkey FROM d WHERE r <= floor(0.1 * n)""")  # fmt: skip
def _(t):
    by = F.conv(F.substring(F.md5(F.concat(F.lit("1:"), F.col("o_orderkey").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return A.uniform(t.orders.select("o_orderkey", "o_custkey"), 0.1, "o_orderkey", by=by)


@query("OP191_sample_with_replacement")
def _(t):
    return A.with_replacement(t.orders.select("o_orderkey"), 0.1)


@query("OP192_random_walks")
def _(t):
    return A.walk_sample(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey", ["o_custkey", "o_orderpriority"], 0.1)


@query("OP194_position_lists", "SELECT c_mktsegment AS value, list_sort(list(c_custkey)) AS tids, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(t):
    return R.position_lists(t.customer, "c_mktsegment", "c_custkey")


_UNIT = "WITH u AS (SELECT vec_id, label, embedding AS e FROM embeddings)"


@query("OP112_cluster_ranked_sample", f"""{_UNIT}, d AS (SELECT a.vec_id, a.label, round(sum(1 - list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[]))), 6) AS s, count(*) AS n FROM u a JOIN u b ON a.label = b.label GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM d)
  SELECT vec_id, label FROM k WHERE r <= greatest(1, floor(n * 0.2))""")  # fmt: skip
def _(t):
    return A.cluster_ranked(t.embeddings, "vec_id", "embedding", "label", 0.2).select("vec_id", "label")


@query("OP196_sample_rounds")
def _(t):
    run = lambda s, seed: D.discover_table(s, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"], support=10, confidence=0.19, levels=2).select("lhs", "rhs")
    return A.rounds(t.orders, 0.3, "o_orderkey", 2, run)


@query("OP150_embedding_matches", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) > 0.5")
def _(t):
    return M.embedding_matches(t.embeddings, "vec_id", "embedding", 0.5, "label")


@query("OP200_token_blocks", f"{_BLOCKS} SELECT token, rid FROM b")
def _(t):
    return J.block_index(_tokens(t), "item_id", "token").select("token", "rid")


@query("OP201_candidate_pairs", f"{_BLOCKS}, c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM b x JOIN b y ON x.token = y.token AND x.rid < y.rid GROUP BY 1, 2), s AS (SELECT rid, count(*) AS n FROM t GROUP BY 1) SELECT a, b, CAST(shared AS BIGINT) AS shared, round(shared / (p.n + q.n - shared), 9) AS jaccard FROM c JOIN s p ON p.rid = a JOIN s q ON q.rid = b WHERE shared / (p.n + q.n - shared) >= 0.05")
def _(t):
    return J.candidate_pairs(_tokens(t), "item_id", "token", 0.05)


#: Planes of a table, and tables, that give nearest() a recall over 0.95 on the embeddings (see the tests).
NEAREST_PLANES = (6, 16)


@query("OP202_nearest_by_hashing")
def _(t):
    planes = M.hyperplanes(*NEAREST_PLANES, 64)
    return M.nearest(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", planes, 5, probe=True)


def _signs_sql(planes, table: int) -> str:
    """SQL for the signature of a table: signs of the projections as bits."""
    return " + ".join(f"CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), [{', '.join(repr(float(x)) for x in plane)}]) > 0 THEN {1 << i} ELSE 0 END" for i, plane in enumerate(planes[table]))


def _buckets_sql(planes) -> str:
    return " UNION ALL ".join(f'SELECT vec_id, {i} AS "table", CAST({_signs_sql(planes, i)} AS BIGINT) AS bucket FROM embeddings' for i in range(len(planes)))


@query("OP203_hash_buckets", _buckets_sql(M.hyperplanes(12, 4, 64)))
def _(t):
    return M.buckets(t.embeddings, "vec_id", "embedding", M.hyperplanes(12, 4, 64))


@query("OP204_superbit_signatures", f"SELECT vec_id, [{', '.join(_signs_sql(M.superbit(8, 2, 64), i) for i in range(2))}] AS signature FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", M.signatures(F.col("embedding"), M.superbit(8, 2, 64)).alias("signature"))


@query("OP205_matched_pairs")
def _(t):
    pairs = _names(t).select("a", "b", S.vector(16)(F.col("a"), F.col("b")).alias("similarities"))
    return M.match_labels(pairs).select("a", "b", "match")


@query("OP205b_matched_pairs_autoencoder")
def _(t):
    pairs = _names(t).select("a", "b", S.vector(16)(F.col("a"), F.col("b")).alias("similarities"))
    return M.autoencoder_labels(pairs).select("a", "b", "match")


@query("OP206_matched_pairs_scaled")
def _(t):
    pairs = _names(t).select("a", "b", S.vector(15)(F.col("a"), F.col("b")).alias("similarities"))
    return M.match_labels(pairs, scale=True).select("a", "b", "match")


@query("OP207_scored_by_plugin", f"{_NAMES}, m AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS score FROM p) SELECT a, b, round(score, 9) AS score FROM m WHERE score > 0.5")
def _(t):
    scorer = lambda a, b: 1 - S.normalized_levenshtein_column(a, b)  # noqa: E731  any function of two columns
    return M.scored_pairs(_names(t), scorer, "a", "b", 0.5).withColumn("score", F.round("score", 9))


@query("OP208_summaries", """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\f\\r\\x0B]+'), lambda x: x <> '') AS ws FROM benchmark), k AS (SELECT item_id, unnest(ws) AS token, unnest(range(0, len(ws))) AS place FROM w), d AS (SELECT token, count(DISTINCT item_id) AS df FROM k GROUP BY 1),
  f AS (SELECT item_id, token, count(*) AS tf, min(place) AS place FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tf * ln((SELECT count(*) FROM benchmark) / df) DESC, place) AS rank FROM f JOIN d USING (token))
  SELECT item_id, string_agg(token, ' ' ORDER BY place) AS summary FROM r WHERE rank <= 10 GROUP BY 1""")  # fmt: skip
def _(t):
    return M.idf_keep(t.benchmark, "item_id", T.split_words(F.lower("text")), 10)


@query("OP208b_marked_kinds", "SELECT item_id, regexp_replace(text, '\\b([0-9][0-9A-Za-z.-]*)\\b', '[NUM] \\1 [/NUM]', 'g') AS marked FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", M.inject_kinds(F.col("text")).alias("marked"))


@query("OP208c_augmented")
def _(t):
    return t.benchmark.select("item_id", *[M.augmented(F.col("text"), F.col("item_id"), k).alias(k) for k in ("drop", "swap", "append", "trim")])


@query("OP218_rule_pairs")
def _(t):
    return A.random_pairs(t.nation.select(F.col("n_nationkey").alias("id")), "id", 40)
