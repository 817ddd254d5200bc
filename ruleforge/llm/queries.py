"""The queries of this package: thin digests over whole tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digest=True)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed_bytes

    return removed_bytes(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed_words

    return removed_words(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .chat import digests

    said = r"\### Assistant: </turn> ok"
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    return digests(turns, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("n_tokens")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"), digest=True)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_html_extraction, op3_quality_classifier, op4_suffix_array_dedup, op5_exact_top_k, op6_ngram_jaccard_join, op7_substring_dedup, op8_benchmark_decontamination, op9_chat_formatting, op10_secret_scans)}
_WORDS = """
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM t),"""

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM d)),
        g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
        m AS (SELECT doc_id, i, coalesce(i > max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM g),
        k AS (SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
        r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY ALL),
        e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM r
              UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), max(d.n) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
        x AS (SELECT e.doc_id, string_agg(substr(h, 2 * e.a + 1, 2 * (e.b - e.a)), '' ORDER BY e.a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id),
        c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN x USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op5_exact_top_k": """
        WITH v AS (
          SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_ngram_jaccard_join": _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("WITH t", "WITH RECURSIVE t")
    + """
        v AS (SELECT doc_id, p, string_agg(word, ' ') OVER r AS s, count(*) OVER r AS n FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
        h AS (SELECT DISTINCT v.doc_id, s FROM v JOIN t USING (doc_id) WHERE n = 4 OR (p = 1 AND len(ws) < 4)),
        z AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        q AS (SELECT a AS node, a AS near FROM u UNION SELECT q.node, u.b FROM q JOIN u ON q.near = u.a),
        f AS (SELECT node, min(near) AS least FROM q GROUP BY node)
        SELECT t.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(f.least, t.doc_id) AS component_id
        FROM t LEFT JOIN z USING (doc_id) LEFT JOIN f ON f.node = t.doc_id""",
    "op7_substring_dedup": _WORDS.format(text="coalesce(text, '')")
    + """
        v AS (SELECT doc_id, p, string_agg(word, ' ') OVER r AS s, count(*) OVER r AS n FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM v WHERE n = 13),
        g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM f WHERE least < doc_id),
        k AS (SELECT w.doc_id, count(g.p) AS removed, string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
        SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)""",
    "op9_chat_formatting": r"""
        WITH c AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(t)),
        e AS (
          SELECT *, length(regexp_replace(text, '(\\*)(### System: |### User: |### Assistant: |### Role: |<\|text\|>|</turn>)', '\\\1\2', 'g')) + 9
            + length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' END) AS chars FROM c)
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
