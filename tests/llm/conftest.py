import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) or (id, text, source) rows, with extra columns that clash with inner names."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.selectExpr("*", "1 AS h", "'x' AS row", "2 AS size", "3 AS keep_id", "4 AS fp")

    return make


@pytest.fixture
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
