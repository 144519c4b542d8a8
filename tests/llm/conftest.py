import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, a long text,
    columns whose names the operators might use themselves."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
    rows = [(0, "The quick brown fox jumps over the lazy dog again and again.", "a"), (1, None, "b"), (2, "", None),
            (3, " \t\n ", "b"), (4, long, "a"), (5, "same text here, twice", "c"), (5, "same text here, twice", "c"),
            (6, "same text here, twice", None), (None, "a row without id", "b"), (None, None, None), (7, "x", "c"),
            (8, "The Quick brown fox jumps over the lazy dog again and again.", "d")]
    extra = "key long, fp string, row_hash string, size int, target string, rate int, cut int, rank int, _row int, _mix int, _score int, word string"
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), *[None] * 12) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, " + extra)
