import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows, and extra columns of clashing names."""

    def build(texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n\t "), (None, texts[0]), rows[0]]
        named = [(i, t, "blob", "words", 1, "x", None) for i, t in rows]
        return spark.createDataFrame(
            named, "doc_id LONG, text STRING, blob STRING, _text STRING, key INT, source STRING, lang STRING"
        )

    return build


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
