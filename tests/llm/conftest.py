import pytest


@pytest.fixture
def table(spark):
    """documents rows (doc_id, text) with columns whose names clash with those of results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), 7, 0.5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, score double, spans string")

    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
