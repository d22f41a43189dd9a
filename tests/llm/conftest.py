import pytest

from corpus_rows import CLASHING, DOCS


@pytest.fixture(scope="session")
def frame(spark):
    """Documents as a table with extra columns of clashing names."""

    def make(rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHING])

    return make


@pytest.fixture(scope="session")
def docs(frame):
    return frame(DOCS)


@pytest.fixture(scope="session")
def texts(spark, sf):
    """The small documents table on the driver: (doc_id, text)."""
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
