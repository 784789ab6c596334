"""Small fixtures for the text operators."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
ODD = [
    None,
    "",
    " \t\n",
    "a",
    "one two",
    "one two three",
    "Ünï cödé ΣΑΣ İstanbul 你好 don't <|endoftext|> x",
    "a" * 20_000,
    "word " * 6_000,
    "x\x1cy\x85z\xa0w",
    "1.2.3.4.5.6.7.8 a@b.c_d@e.f +1 (234) 555-1234 4111 1111 1111 1111",
]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, **extra):
        rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, docs_of):
    """Odd texts, with repeated rows and a null id."""
    once = docs_of(ODD)
    nobody = spark.createDataFrame([(None, "one two three", None, None, None)], DOCS)
    return once.union(once).union(nobody)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real(spark):
    """(doc_id, text) of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
