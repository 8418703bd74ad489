"""Shared cases of the llm tests."""

import pytest
from pyspark.sql import types as T

EDGES = [(0, None), (1, ""), (2, " "), (3, "a"), (4, "the same words again and again"), (5, "the same words again and again"), (5, "the same words again and again"), (None, "no id"), (6, "é漢😀 \n\t x" * 3), (7, "long " * 40_000)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame of (doc_id, text) pairs with further columns, two of
    them with names that the operators use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("kept", T.StringType()), T.StructField("spans", T.StringType())])

    def make(rows, parts=3):
        return spark.createDataFrame([(d, t, "en", "x", "y") for d, t in rows], schema).repartition(parts)
    return make
