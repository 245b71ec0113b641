import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    return docs_of([(1, None, "a"), (2, "", None), (3, "  \n\t ", "b"), (None, "null id words here", "a"), (4, long, "b"), (5, same, None), (5, same, None), (6, same, "a"), (7, "x", "é"), (None, None, None), (8, "x" * 200_000, "a")])
