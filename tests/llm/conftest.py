"""Fixtures of the operators' tests: a small table with every odd case."""

import pytest
from pyspark.sql import types as T

LONG = "word " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows,
    and columns whose names the operators use inside."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("n", T.StringType()),
        T.StructField("score", T.StringType()), T.StructField("rid", T.LongType()),
        T.StructField("digest", T.StringType()), T.StructField("ids", T.StringType()),
        T.StructField("held_out", T.StringType()), T.StructField("n_chars", T.LongType())])
    texts = [(1, "The quick brown fox jumps over the lazy dog, then rests."), (2, None), (3, ""), (4, " \t\n "),
             (5, LONG), (6, "The quick brown fox jumps over the lazy dog, then rests."),
             (6, "The quick brown fox jumps over the lazy dog, then rests."), (None, "a null id"), (None, None),
             (7, "Mail a.b@c.example.com or +1 (555) 010-9999 from 10.0.0.1; \U0001f600 naïve ÀÉ"), (8, "x" * 30_000)]
    return spark.createDataFrame([(i, t, None, "n", None, 0, "d", None, "h", None) for i, t in texts], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
