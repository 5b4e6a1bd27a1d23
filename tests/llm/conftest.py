import hashlib  # noqa: F401
import pytest
from pyspark.sql import types as T


@pytest.fixture
def documents(spark):
    """A function that makes a documents table of (doc_id, text) pairs, with an extra column."""

    def make(rows):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], schema)

    return make
