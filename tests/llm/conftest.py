import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with null columns and extra columns whose names clash with internal ones."""

    def make(texts, sources=None):
        rows = [(i, t, None, (sources or [f"s{i % 3}" if i % 4 else None for i in range(len(texts))])[i], None, "x", "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Empty, blank, very long, repeated and non-ASCII texts."""
    base = " ".join(f"w{i}" for i in range(80))
    return [None, "", " \n\t", base, base, base + " more", "a b c " * 30000, "É" * 5000, "x y   z", "ÄÖ #$% " * 60, "line\nline\nline\n" + base]
