import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, ddl): a DataFrame over two partitions."""

    def make(rows, ddl):
        return spark.createDataFrame(rows, ddl).repartition(2) if rows else spark.createDataFrame([], ddl)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
