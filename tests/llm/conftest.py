import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """A documents table of texts, with ids from 0 unless given, and sources in turn."""

    def build(texts, ids=None, source=lambda i: f"s{i % 3}"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(d, t, "en", source(k), None if t is None else len(t)) for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOCS)

    return build
