import math
import random

from pyspark.sql import functions as F
from ruleforge.llm import graph, topk


def brute_top(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.choice((-1.0, 0.5, 0.25, 1.0)) for _ in range(20)]) for i in range(400)]
    rows += [(1000, [float("nan")] * 20), (1050, None), (1100, [None] * 20), (1150, [float("inf")] * 20), (None, [1.0] * 20), (1200, [1.0, 2.0]), (1201, [3.0, 1.0]), (1250, []), (1251, []), (-50, [0.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("size", F.lit(1)).withColumn("row", F.lit(2))
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_rows_of_one_query_id(spark):
    """A query is a vec_id: its best are taken of the pairs of all its rows, as its SQL does."""
    import duckdb
    from ruleforge.llm.queries import ORACLE_SQL

    r = random.Random(2)
    rows = [(i, [r.choice((-1.0, 0.5, 1.0)) for _ in range(6)]) for i in range(60)]
    rows += [(50, rows[50][1]), (0, [1.0] * 6), (7, rows[7][1]), (7, [0.25] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    import pyarrow as pa

    embeddings = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})  # noqa: F841  read by name
    want = duckdb.sql(ORACLE_SQL["op5_exact_top_k"]).fetchall()
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want) and len(want) == 10


def test_large_components(spark):
    rows = [(0, [1e12] * 4), (1, [1e12, -1e12, 3.0, 0.0]), (2, [1.0] * 4), (50, [2e9] * 4)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))[0][:3] == (0, 1, 50)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark, sf_dir):
    import brute
    import corpus_pipeline as C
    from ruleforge.llm import bpe, decontaminate, quality, secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = graph.written(stage(spark, docs, sf_dir))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "quality":
            model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            rejected = {r.doc_id for r in quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).where("score < 0.5").collect()}
            assert set(before) - set(after) == rejected and rejected
        if name == "near_duplicates":
            groups = brute.jaccard(list(before.items()), 5, 80)
            assert set(after) == {d for d, n, c in groups if c == d}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(t in x for t in items for x in after.values()) and all(any(t in before[d] for t in items) for d in set(before) - set(after))
        if name == "secrets":
            assert set(after) == set(before) and not any(secrets.base_spans(t) for t in after.values())
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        sizes.append(docs.count())
    last = C.STAGES[-1][1](spark, docs, sf_dir)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(last, __import__("public_tokenizers").path(C.TOKENIZER)).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in C.run(spark, sf_dir).select("doc_id").collect()) == sorted(back)
    assert decontaminate.SHARE < 1 and sizes == sorted(sizes, reverse=True)


def test_near_duplicates_by_five_words(spark):
    import brute
    import corpus_pipeline as C

    words = [f"w{i}" for i in range(100)]
    near = words[:30] + ["x"] + words[31:60] + ["y"] + words[61:]  # 86 of 106 shingles of five words, 89 of 105 of four
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1]))]
    assert {d for d, n, c in brute.jaccard(rows) if c == d} == {1, 2, 3}
    kept = {r.doc_id for r in C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {d for d, n, c in brute.jaccard(rows, 5, 80) if c == d} == {1, 3}


ODD = [(1, "one two three " * 40, "de", "s", 9), (1, "one two three " * 40, "de", "s", 9), (2, None, None, None, None), (None, "", "en", "s", 0), (None, None, "en", "s", 0), (3, " \n\t", "en", "s", 3), (4, "x" * 100_000, "en", "s", 1), (5, "pwd = opensesame " + "word " * 30_000, "en", "s", 2)]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names, and empty tables."""
    import corpus_pipeline as C

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("block", "key", "row", "score_of_quality", "lost_id", "spans")})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a benchmark passage that stands in no document"), (2, None)], "item_id long, text string")
    for name, rows, marks, bench in (("odd", docs, labels, items), ("empty", docs.limit(0), labels.limit(0), items.limit(0))):
        sf = f"{tmp_path}/{name}"
        rows.write.parquet(f"{sf}/documents.parquet")
        marks.write.parquet(f"{sf}/labels.parquet")
        bench.write.parquet(f"{sf}/benchmark.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for stage_name, stage in C.STAGES[:-1]:
            after = graph.written(stage(spark, now, sf))
            assert after.columns == now.columns and after.schema == now.schema, stage_name
            before, left = [r.doc_id for r in now.collect()], [r.doc_id for r in after.collect()]
            if stage_name in ("decontamination", "secrets"):
                assert sorted(before, key=str) == sorted(left, key=str)
            if stage_name == "near_duplicates" and 1 in before:
                assert left.count(1) == 1 and set(left) == set(before) and left.count(None) == before.count(None)
            now = after
        assert C.STAGES[-1][1](spark, now, sf).count() == now.count() == C.run(spark, sf).count()


def test_every_query_runs(spark, sf_dir):
    from ruleforge.llm.queries import QUERIES

    names = sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    for n in names:
        assert QUERIES[n](spark, sf_dir).limit(1).count() >= 0
