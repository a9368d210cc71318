import pytest

SF = "/root/testdata/sf0.001"

#: Columns that an operator might use itself; they must pass or be ignored.
CLASHING = ["id", "row", "node", "root", "n", "bucket", "place", "words", "range", "copied", "t1", "lang_pred"]

EDGE_TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "same words in a row here"),
    (7, "same words in a row here"), (7, "same words in a row here"), (None, "a row without an id"),
    (8, "x" * 300_000), (9, "long text of many words " * 20_000), (10, "ünï cödé \U0001f600 ÄÖ"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in EDGE_TEXTS],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(1).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
