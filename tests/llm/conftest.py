import pytest

#: A column name that operators use inside; extra columns may clash with it.
CLASHES = "digest string, rep long, value long, component long, __id long, kept boolean, part int, length long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids' neighbours: null, empty, blank, very long, repeated and equal texts, and clashing extra columns."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = [None, "", "  \n\t ", "one two", "one two", long_text, "A b c d e f g h", "a B c d e f g h", "12 34 !!", "The the the cat sat on the mat again"]
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1, 2, 3, 4, True, 5, 6) for i, t in enumerate(texts)]
    rows += [rows[3], rows[6]]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
