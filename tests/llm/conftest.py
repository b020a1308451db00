import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from ``(doc_id, text, ...)`` rows, with columns whose names operators use inside."""
    def make(rows, more=""):
        full = [tuple(r) + (1, 2, 3, 4) for r in rows]
        return spark.createDataFrame(
            full, f"doc_id bigint, text string{more}, token int, sid int, block int, text_key int")
    return make
