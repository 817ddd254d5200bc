"""A training-data pipeline over documents, in stages that each call one operator of ruleforge.llm.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> secret scans -> byte-level BPE.
Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.

Defined cases, of every stage: null and empty texts are documents like others (the classifier scores them; they
are near duplicates of nothing, hold no item and no secret, and have no tokens); very long texts are worked on
whole; a null doc_id stays null; of rows alike in doc_id and text the near-duplicate stage keeps one (if they
have words), the others all; columns other than doc_id and text, whatever their names, pass through; empty
tables give no rows, and without labels or items nothing is rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleforge.deploy import shipped
from ruleforge.llm import bpe, decontaminate, jaccard, quality, secrets
from ruleforge.llm.graph import written

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    column = "score_of_quality"
    while column in docs.columns:
        column += "_"
    return quality.score(docs, model, column).where(F.col(column) >= 0.5).drop(column)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 80 % of their shingles of five words alike."""
    return jaccard.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars brought up to date."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [(name, shipped(f)) for name, f in (("quality", good_quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("secrets", without_secrets), ("tokens", tokens))]

#: SQL can express neither the trained stages nor the embedding; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
