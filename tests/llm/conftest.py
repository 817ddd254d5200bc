import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def word(r):
    return "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty, blank, long, copies, near copies, ties, low entropy, other scripts."""
    r = random.Random(4)
    base = " ".join(word(r) for _ in range(120))
    near = base.split()
    near[60] = "other"
    shared = " ".join(word(r) for _ in range(40))
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, shared + " " + " ".join(word(r) for _ in range(50))), (5, " ".join(word(r) for _ in range(50)) + "\n" + shared),
        (6, None), (7, ""), (8, "  \n\t "), (9, "one two three"), (10, "ONE Two three"), (11, "a" * 5000), (12, "a" * 300), (13, "ab " * 400), (14, " ".join(word(r) for _ in range(30000))),
        (15, "word"), (16, "日本語 テキスト 🎉   x y " + shared), (2, base), (2, "tie " + base), (None, base), (None, None), (-5, shared), (17, base + " " + base),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with more columns, some of them named as the operators' own."""
    df = spark.createDataFrame(edge_rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("block", "bucket", "key", "row", "score", "spans", "lang")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
