import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([(doc_id, text, source?)...]) -> a documents table with an extra clashing column."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("fp", "size", "n", "word", "key", "score", "sid"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
