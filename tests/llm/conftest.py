from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("_row", "_text", "key", "base", "did", "_id", "h")]])


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts or (doc_id, text) pairs, with extra columns whose names clash with inner ones."""

    def build(texts):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 7) for i, t in rows], DOCS)

    return build
