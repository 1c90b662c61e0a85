import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept_id int, secret_text int")

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "palavra longa " * 20_000
    return docs([(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (6, "uma só"), (6, "uma só"), (None, "sem número aqui agora"), (7, "x" * 50_000)])
