import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("Text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("key", T.StringType()),
    T.StructField("c0", T.IntegerType())])

LONG = " ".join(f"word{i % 977} and{i}" for i in range(20_000))


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en" if t else None, "s", None, "other", 0.5, "k", 7) for i, t in zip(ids, texts)]


@pytest.fixture(scope="session")
def frame(spark):
    """Texts (and ids) -> documents with extra columns whose names clash."""
    return lambda texts, ids=None, parts=3: spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows; columns whose names clash."""
    texts = [None, "", "  \n", "One two three four five", "ONE two three four five", LONG, LONG, "x", "x", "é ß 你好 🙂", None]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 8, None, None]
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
