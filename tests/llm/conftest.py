import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given (doc_id, text) or longer rows."""

    def make(rows):
        full = [(*r, *([None] * (5 - len(r)))) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make
