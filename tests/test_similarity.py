"""Distances by their definitions, and columns against plain versions."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from ruleforge.functions import similarity as S
from ruleforge.functions import textclean as T
from ruleforge.operators import matching as M
from ruleforge.operators import sampling as A

texts = st.text("abc ", max_size=8)


def slow_lcs(a, b):
    return max(len(s) for n in range(min(len(a), len(b)) + 1) for s in itertools.combinations(a, n) if is_sub(s, b))


def is_sub(s, b):
    rest = iter(b)
    return all(c in rest for c in s)


def test_known_values():
    assert S.lcs_distance("AGCAT", "GAC") == 4 and S.lcs_length("AGCAT", "GAC") == 2
    assert S.damerau("ca", "abc") == 2 and S.optimal_string_alignment("ca", "abc") == 3
    assert S.levenshtein("kitten", "sitting") == 3
    assert S.jaro_winkler("abcdefgh", "abcdefxx") == pytest.approx(0.93, abs=0.01)
    assert S.ngram_distance("a", "b", 2) == 1 and S.ngram_distance("a", "ab", 3, compat=True) == 0.5
    assert S.optimal_string_alignment("", "abc") == 3 and S.optimal_string_alignment("", "abc", compat=True) == 0
    assert S.sift4("", "abc") == 3 and S.sift4("abc", "abc") == 0 and S.sift4("This is the first string", "And this is another string") == 11
    assert S.sift4("a b c", "a x c", tokens="words") == 1
    assert S.weighted_levenshtein("ab", "b", delete=lambda c: 5.0) == 5 and S.qgram("ABCD", "ABCE", 2) == 2
    assert S.sift4("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Amet Lorm ispum dolor sit amet, consetetur adixxxpiscing elit.", 10) == 12
    assert S.sift4("abcdef", "badcfe", limit=2) == 2 and S.sift4("aab", "aba", swap_cost=lambda i, j: 3) >= S.sift4("aab", "aba")
    assert S.vector4(["a", "", ""], ["a", "", "b"]) == [1.0] * 8 + [0.0] * 4


@settings(max_examples=60, deadline=None)
@given(texts, texts)
def test_axioms(a, b):
    for f in (S.levenshtein, S.damerau, S.optimal_string_alignment, S.lcs_distance, S.metric_lcs, S.ngram_distance, S.qgram):
        assert f(a, a) == 0 and f(a, b) >= 0 and f(a, b) == pytest.approx(f(b, a))
    for f in (S.cosine, S.jaccard, S.overlap_coefficient, S.sorensen_dice, S.jaro_winkler):
        assert f(a, a) == 1 and 0 <= f(a, b) <= 1 + 1e-9
    assert S.damerau(a, b) <= S.optimal_string_alignment(a, b) <= S.levenshtein(a, b)
    assert S.lcs_length(a, b) == slow_lcs(a, b)


def plain_vectors(a, b):
    """The vectors of measures by the plain functions, one after the other."""
    n, m = max(len(a), len(b)), len(a) + len(b)
    edit = 1 - S.levenshtein(a, b) / max(n, 1)
    sixteen = [0.0] * 16 if not a or not b else [
        S.cosine(a, b, 1), 1 - S.damerau(a, b) / n, S.jaccard(a, b, 2), S.overlap_coefficient(a, b, 3), S.jaro_winkler(a, b), edit, 1 - S.lcs_distance(a, b) / m, 1 - S.metric_lcs(a, b), 1 - S.ngram_distance(a, b, 2, compat=True), edit,
        1 - S.optimal_string_alignment(a, b) / n, S.overlap_coefficient(a, b, 2), 1 - S.qgram(a, b, 2) / n, S.sorensen_dice(a, b, 2), edit, S.overlap_coefficient(a, b, 1),
    ]
    fifteen = [
        S.cosine(a, b, 1), -S.damerau(a, b), S.jaccard(a, b, 1) - 1, S.jaro_winkler(a, b), S.jaro_winkler(a, b), -S.levenshtein(a, b), -S.lcs_distance(a, b), -S.metric_lcs(a, b), -S.ngram_distance(a, b, 2, compat=True), edit,
        -S.optimal_string_alignment(a, b, compat=True), S.overlap_coefficient(a, b, 3) - 1, -S.qgram(a, b, 1), S.sorensen_dice(a, b, 2), -S.weighted_levenshtein(a, b),
    ]
    return sixteen, fifteen, [-S.levenshtein(a, b), -S.lcs_distance(a, b)] if a and b else [0.0, 0.0]


def test_vectors_equal_plain(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab c") for _ in range(r.randrange(0, 9)))
    pairs = [(word(), word()) for _ in range(120)] + [("", ""), ("", "x"), ("abcabc", "abcabc"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    words = lambda c: F.split(c, " ")
    for row in df.select("a", "b", S.vector(16)(a, b).alias("s"), S.vector(15)(a, b).alias("f"), S.vector(2)(a, b).alias("t"), S.token_vector()(words(a), words(b)).alias("w")).collect():
        if row.a is None or row.b is None:
            assert row.s is None and row.f is None and row.t is None and row.w is None
        else:
            for got, want in zip((row.s, row.f, row.t), plain_vectors(row.a, row.b)):
                assert got == pytest.approx(want, abs=1e-9), (row.a, row.b)
            assert row.w == pytest.approx(S.vector4(row.a.split(" "), row.b.split(" ")))


def test_columns_equal_plain(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("ab c") for _ in range(r.randrange(0, 9))), "".join(r.choice("ab c") for _ in range(r.randrange(0, 9)))) for _ in range(80)] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    both = {
        "cosine": (S.cosine_column(a, b, 2), lambda x, y: S.cosine(x, y, 2)), "jaccard": (S.jaccard_column(a, b, 2), lambda x, y: S.jaccard(x, y, 2)), "dice": (S.dice_column(a, b, 2), lambda x, y: S.sorensen_dice(x, y, 2)),
        "overlap": (S.overlap_column(a, b, 2), lambda x, y: S.overlap_coefficient(x, y, 2)), "qgram": (S.qgram_column(a, b, 2), lambda x, y: S.qgram(x, y, 2)), "edit": (S.levenshtein_column(a, b), S.levenshtein),
        "jw": (S.metric("jaro_winkler")(a, b), S.jaro_winkler), "damerau": (S.metric("damerau")(a, b), S.damerau),
    }
    for row in df.select("a", "b", *[c.cast("double").alias(n) for n, (c, _) in both.items()]).collect():
        for n, (_, f) in both.items():
            want = None if row.a is None or row.b is None else f(row.a, row.b)
            assert row[n] == (None if want is None else pytest.approx(want, abs=1e-9)), (n, row)
    assert df.where(S.similarity_predicate("levenshtein", a, b, 1.0)).count() == sum(x == y for x, y in pairs)


def test_cleaning(spark):
    df = spark.createDataFrame([("A - b,\tC(d)\n",), ("12-34 ab--cd 5",), ("x(aside)y 13800138000z",), ("楼12号ab3-45678901-c",)], "s string")
    s = F.col("s")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(T.clean_sentence(s))[0] == "a - b , c ( d )"
    assert get(T.remove_signs(s))[1] == "12-34abcd5"
    assert get(T.remove_asides(s))[2] == "xy z"
    assert get(T.letters_digits(s))[3] == "12ab345678901c" and get(T.short_codes(s))[3] == "12-ab3-c"
    assert get(T.code_before(s, "号"))[3] == "12" and get(T.last_code(s))[1] == "5"
    assert get(T.remove_words(F.lit("深圳市福田区x")))[0] == "x" and get(T.plain_digits(F.lit("二〇")))[0] == "20"
    assert get(T.grams(F.lit("abcd"), 3))[0] == ["abc", "bcd"] and get(T.grams(F.lit("a"), 3))[0] == []


def test_matching(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    planes = M.hyperplanes(4, 3, 3)
    by_column = {r.id: r.s for r in df.select("id", M.signatures(F.col("v"), planes).alias("s")).collect()}
    by_batch = {}
    for r in M.buckets(df, "id", "v", planes).collect():
        by_batch.setdefault(r.id, {})[r.table] = r.bucket
    assert by_batch == {i: dict(enumerate(s)) for i, s in by_column.items()}
    near = M.nearest(df, df.where("id = 3"), "id", "v", planes, 3, "euclidean", probe=True).collect()
    assert near and [r.distance for r in sorted(near, key=lambda r: r.rank)] == sorted(r.distance for r in near)
    q = M.superbit(3, 1, 3)[0]
    assert abs(q @ q.T - M.np.eye(3)).max() < 1e-9
    for kind, want in (("l1", 3.0), ("squared", 5.0), ("euclidean", 5**0.5), ("centred", 0.5)):
        assert spark.range(1).select(M.distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0)), kind)).first()[0] == pytest.approx(want)
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert dict(map(tuple, M.entity_ids(links, "a", "b").collect())) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    kept = A.cluster_ranked(df, "id", "v", "g", 0.3)
    assert kept.groupBy("g").count().where("count <> 3").count() == 0
    pairs = spark.createDataFrame([(i, [0.9 + 0.001 * (i % 7), 0.8] if i % 2 else [0.1, 0.2 + 0.001 * (i % 5)]) for i in range(40)], "i long, similarities array<double>")
    assert {(r.i % 2 == 1) == r.match for r in M.match_labels(pairs).collect()} == {True}
    assert M.scored_pairs(spark.createDataFrame([("ab", "ab"), ("a", "z")], "a string, b string"), S.metric("jaccard", k=1), "a", "b", 0.5).count() == 1
    text = spark.createDataFrame([(1, "the red fox"), (2, "the blue fox"), (3, "the 42 end")], "id long, s string")
    assert {r.id: r.summary for r in M.idf_keep(text, "id", T.split_words(F.col("s")), 1).collect()} == {1: "red", 2: "blue", 3: "42"}
    assert text.select(M.inject_kinds(F.col("s"))).collect()[2][0] == "the [NUM] 42 [/NUM] end"


def test_augmented_texts(spark):
    df = spark.createDataFrame([(i, "one two three four five") for i in range(40)] + [(99, "single"), (100, None)], "id long, t string")
    kinds = ("drop", "swap", "append", "trim")
    for r in df.select("id", "t", *[M.augmented(F.col("t"), F.col("id"), k).alias(k) for k in kinds]).collect():
        if r.id >= 99:
            assert all(r[k] == r.t for k in kinds)
            continue
        words = r.t.split(" ")
        assert len(r.drop.split(" ")) == 4 and set(r.drop.split(" ")) < set(words)
        assert sorted(r.swap.split(" ")) == sorted(words) and sum(a != b for a, b in zip(r.swap.split(" "), words)) == 2
        assert len(r.append.split(" ")) == 6 and list(dict.fromkeys(r.append.split(" "))) == words
        assert words[: len(r.trim.split(" "))] == r.trim.split(" ")


def test_autoencoder_labels(spark):
    r = random.Random(4)
    rows = [(i, [(0.9 if i % 4 == 0 else 0.1) + r.gauss(0, 0.03) for _ in range(6)]) for i in range(200)]
    found = M.autoencoder_labels(spark.createDataFrame(rows, "id long, similarities array<double>")).select("id", "match").collect()
    assert sum(x.match == (x.id % 4 == 0) for x in found) >= 190


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_of_nearest_by_hashing(spark, sf):
    """Against brute force, with the registered planes."""
    import numpy as np
    from ruleforge.plans import registry

    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in registry.queries()["OP202_nearest_by_hashing"](spark, f"/root/testdata/sf{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = wanted = 0
    for i in np.flatnonzero(ids % 50 == 0):
        order = [j for j in np.argsort(-(m @ m[i]), kind="stable") if j != i][:5]
        right += len(got.get(int(ids[i]), set()) & set(ids[order].tolist()))
        wanted += 5
    assert right >= 0.93 * wanted, right / wanted


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_keeps_no_pairs(spark, monkeypatch):
    """Blocks of queries and rows give what all pairs give, no join makes pairs, and what has no distance is not near."""
    import numpy as np

    m = np.random.default_rng(5).standard_normal((300, 6))
    m[200:204] = m[3]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, [0.0] * 6), (901, [None] + [1.0] * 5), (902, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    planes = M.hyperplanes(4, 5, 6)
    monkeypatch.setattr(M, "QUERY_ROWS", 9, raising=False)
    monkeypatch.setattr(M, "CANDIDATE_ROWS", 20, raising=False)
    monkeypatch.setattr(M, "SCORED_AT_ONCE", 64, raising=False)
    code = (np.einsum("nd,tbd->ntb", m, planes) > 0) @ (1 << np.arange(4))
    for kind in ("cosine", "euclidean", "l1"):
        own = df if kind == "cosine" else df.where("id <> 900")  # zeros have distances, but no cosine
        out = M.nearest(own, own.where("id % 7 = 3"), "id", "v", planes, 5, kind, probe=True)
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
        assert set(got) == set(range(3, 300, 7))
        for q, found in got.items():
            met = [j for j in range(300) if j != q and any((int(a) ^ int(b)).bit_count() <= 1 for a, b in zip(code[q], code[j], strict=True))]
            d = {"cosine": lambda j, q=q: 1 - m[q] @ m[j] / np.sqrt((m[q] @ m[q]) * (m[j] @ m[j])), "euclidean": lambda j, q=q: np.sqrt(((m[q] - m[j]) ** 2).sum()), "l1": lambda j, q=q: np.abs(m[q] - m[j]).sum()}[kind]
            want = sorted((round(float(d(j)), 9), j) for j in met)[:5]
            assert [i for _, i, _ in sorted(found)] == [j for _, j in want]
            assert [x for *_, x in sorted(found)] == pytest.approx([x for x, _ in want], abs=1e-8)
    assert "Join" not in plan_of(out)


def test_embedding_matches_in_parts(spark, monkeypatch):
    """Parts of a block meet as matrices: no join makes the pairs of a block, and none of them is lost."""
    import numpy as np

    m = np.random.default_rng(6).standard_normal((260, 4))
    m[100:120] = m[7]
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(m)] + [(900, 0, [0.0] * 4), (901, 0, [None, 1.0, 1.0, 1.0]), (902, 0, None), (903, None, [1.0] * 4), (904, 1, [1.0] * 3), (905, 1, [1.0] * 3)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    monkeypatch.setattr(M, "MATCH_ROWS", 16, raising=False)
    monkeypatch.setattr(M, "MATCHED_AT_ONCE", 200, raising=False)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j): round(float(u[i] @ u[j]), 6) for i in range(260) for j in range(i + 1, 260) if i % 3 == j % 3 and round(float(u[i] @ u[j]), 6) > 0.5} | {(904, 905): 1.0}
    found = M.embedding_matches(df, "id", "v", 0.5, "g")
    assert sorted((r.a, r.b, r.cosine) for r in found.collect()) == [(*k, pytest.approx(v, abs=2e-6)) for k, v in sorted(want.items())]
    assert "x.id" not in plan_of(found) and all("<" not in line for line in plan_of(found).splitlines() if "Join" in line)


def test_jaro_winkler_in_batches(spark):
    """Batches give what single pairs give, to the last bit; groups of pairs are spread over tasks."""
    from ruleforge.operators import joins as J

    r = random.Random(3)
    word = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randrange(most)))
    pairs = [(word(x, n), word(x, n)) for x in ("ab", "abcd é") for n in (3, 12, 70) for _ in range(300)] + [("Supplier#000000017", "Supplier#000000071"), ("a\0", "a"), ("", "")]
    short = [(x, y) for x, y in pairs if max(len(x), len(y)) <= S.BATCH_LENGTH]
    assert S.jaro_winkler_batch(*map(list, zip(*short, strict=True))).tolist() == [S.jaro_winkler(x, y) for x, y in short]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    for row in df.select("a", "b", S.metric("jaro_winkler", threshold=0.5)(F.col("a"), F.col("b")).alias("s")).collect():
        assert row.s == (None if row.a is None or row.b is None else S.jaro_winkler(row.a, row.b, 0.5))
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("name"))
    made = J.group_pairs(rows, "g", "id", ["name"])
    assert made.where("id < 40 and id_ < 40").select("g", "id", "name", "id_", "name_").orderBy("id", "id_").collect() == [(i % 2, i, str(i), j, str(j)) for i in range(40) for j in range(i + 2, 40, 2)]
    tasks = made.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 1500 * 1499 and len(tasks) > 2
