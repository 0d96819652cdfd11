import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """rows([(doc_id, text), ...]) -> documents with the usual columns."""

    def make(pairs):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs],
            "doc_id long, text string, lang string, source string, n_chars long",
        )

    return make
