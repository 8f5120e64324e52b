import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty, blank, tiny and long texts, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 10, "x"),
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 10, "x"),
        (2, "The quick brown fox jumps over the lazy dog again", "en", "a", 10, "x"),
        (3, None, None, None, None, None),
        (None, "a text without an id that is long enough to count", "en", "b", 3, "y"),
        (4, "", "en", "b", 0, "y"),
        (5, " \n\t ", "de", "b", 3, "y"),
        (6, "two words", "fr", "c", 9, "z"),
        (7, "two words", "fr", "c", 9, "z"),
        (8, "word " * 20_000, "en", "c", 100_000, "z"),
        (9, "x" * 50_000, "en", "c", 50_000, "z"),
        (10, "é😀 ​ \x00 ▁▁ a  b", "es", "c", 9, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
