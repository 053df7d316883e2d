import pytest
from texts import ODD_TEXTS, prose


@pytest.fixture(scope="session")
def documents(spark):
    """``documents(texts)``: a documents table from texts, numbered from 0."""

    def build(texts, lang="en"):
        rows = [(i, t, lang, "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return build


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS + [prose(1, 300), prose(1, 300), prose(2, 3000), None, ""]
