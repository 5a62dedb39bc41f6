import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (id, text) pairs, with an extra column whose name clashes with inner ones."""

    def build(pairs, parts=3):
        rows = [(i, t, None if i is None else "en", "src", None) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return build
