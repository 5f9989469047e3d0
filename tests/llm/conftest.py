import pytest

DOCS = "doc_id bigint, text string"


@pytest.fixture
def docs_of(spark):
    """A documents table from texts (ids 1, 2, …) or (id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table, and its texts by id."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture
def clashing():
    """Adds columns whose names clash with those operators use, or need quotes."""

    def add(df):
        from pyspark.sql import functions as F

        extra = ("k1", "k2", "n", "id", "m", "start", "keys", "a.b", "bucket", "_gumbel", "item", "weight", "_0")
        # One name differs from a real column in case only; withColumn would replace that.
        return df.select("*", *(F.lit("x").alias(name) for name in (*extra, "TEXT")))

    return add
