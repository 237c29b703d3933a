"""Small tables for the training-data operators."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents from texts, with ids from 0 or as given."""

    def build(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def clashing(documents):
    """Nulls, empty texts, repeated rows, a null id, and extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    texts = ["one two three four five six seven", None, "", "   \n ", "one two three four five six seven", "short", "short"]
    extra = ["id", "h", "line", "words", "ids", "node", "size", "key", "score", "item", "fp", "shard", "template", "row", "k0", "y", "_runs_"]
    return documents(texts, [0, 1, 2, 3, 0, None, 6]).withColumns({c: F.lit("x") for c in extra})
