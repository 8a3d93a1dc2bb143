import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names beside them."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENT)
        return frame.selectExpr("*", "'x' AS kept", "1 AS n_words", "'y' AS component_id", "2 AS batch", "3 AS n_tokens")

    return make
