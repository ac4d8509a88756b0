import pytest

from agora.llm.shipping import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """Make a documents table of (doc_id, text) pairs, with a column that clashes with working names."""

    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t or ""), "own") for i, t in rows]
        frame = spark.createDataFrame(full, DOCS + ", fp string")
        return frame.repartition(parts)

    return make
