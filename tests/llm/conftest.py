import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, ids in order unless given."""

    def make(texts, ids=None, extra=None):
        rows = [(i, t) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("*", *(extra or []))

    return make
