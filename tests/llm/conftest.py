import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("length", T.StringType()), T.StructField("row", T.IntegerType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]) rows, with extra columns of clashing names."""

    def f(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, "x", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return f


ODD = [(0, "a b"), (1, None), (2, ""), (3, " \n\t"), (None, "a  b"), (5, "a b"), (5, "a b"), (6, "x" * 70_000), (7, "é ü 漢字 naïve"), (8, "word " * 9_000)]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
