"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, words, "en", "a"),
        (2, words, "en", "a"),
        (2, words, "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \t\n\x0b\x0c\r ", "en", "b"),
        (None, words + " tail", "en", None),
        (None, None, "de", "c"),
        (6, "x\x1cy " + "é ß 中文 " * 10, "de", "c"),
        (7, "lone", "fr", "d"),
        (8, "z" * 200_000, "fr", "d"),
        (9, "rep " * 400, "fr", "d"),
    ]
    full = [(i, t, g, s, len(t) if t is not None else None, "r", "k", 7) for i, t, g, s in rows]
    return spark.createDataFrame(full, DOC).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
