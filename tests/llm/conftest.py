import pytest


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(rows, lang="en"):
        full = [(i, t, lang, "src", None if t is None else len(t), 1, "x", 2) for i, t in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, fp int, item_id string, span int"
        return spark.createDataFrame(full, kinds)

    return make


ODD = [(None, None), (None, "no id"), (1, ""), (2, " \n\t "), (3, "x"), (4, "same row"), (4, "same row"), (5, "word " * 30_000), (6, None)]
