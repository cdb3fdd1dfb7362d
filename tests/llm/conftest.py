import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table; rows are texts, or (doc_id, text)."""

    def make(rows, extra=""):
        full = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", len(t or "")) for i, t in full]
        frame = spark.createDataFrame(full, DOC)
        return frame.selectExpr("*", extra) if extra else frame

    return make
