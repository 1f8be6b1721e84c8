import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs or (doc_id, text, lang) triples."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows], TEXTS)

    return make


@pytest.fixture(autouse=True)
def stored_tables(request):
    yield
    if "spark" in request.fixturenames:
        from lumenbase.llm.common import release

        release(request.getfixturevalue("spark"))
