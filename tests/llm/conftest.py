import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given texts with a clashing extra column."""

    def make(texts, start=0):
        return spark.createDataFrame([(i + start, t, "en", "s", 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
