import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text,
    and columns whose names clash with working columns."""
    long_text = "\n".join(f"paragraph {i} of a long text that says little more than its number {i * i}" for i in range(4000))
    rows = [(1, None, "s", 1, "x"), (2, "", "s", 2, "x"), (3, " \t\n ", None, 3, "x"), (None, "no id here at all", "s", 4, "x"),
            (5, "the same words in a row that is here twice", "t", 5, "x"), (5, "the same words in a row that is here twice", "t", 5, "x"),
            (5, "another text of the same id, a bit longer", "t", 6, "x"), (7, long_text, "s", 7, "x"),
            (8, "ünïcödé 😀 text — with ▁ marks and \x85 more", "u", 8, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, row string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
