import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (doc_id, text) pairs, with further columns that clash in name."""

    def make(pairs, partitions=3):
        rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in pairs]
        schema = f"{DOCS}, key string, row long, _row string"
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make
