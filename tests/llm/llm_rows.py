"""Fixtures of these tests."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
)


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text[, lang[, source]]), with columns whose names operators use inside."""
    def build(rows):
        frame = spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], DOCS)
        return frame.selectExpr("*", "doc_id AS key", "'x' AS row", "1 AS kept", "text AS body", "2 AS rank", "3 AS size")

    return build


def rows_of(df, order="doc_id"):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[order] is None, r[order] if r[order] is not None else 0, repr(r)))
