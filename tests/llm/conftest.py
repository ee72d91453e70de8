import pytest

LONG = " ".join(f"w{i % 5000}x{i // 7}" for i in range(60_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, and columns with the names operators use inside."""
    rows = [
        (1, "the same text over and over again for all to see", "a", "x", 1.0),
        (1, "the same text over and over again for all to see", "a", "x", 1.0),
        (2, "the same text over and over again for all to see", "b", "x", 1.0),
        (3, None, "a", "x", 1.0),
        (4, "", "a", "x", 1.0),
        (5, "   \n\t ", "a", "x", 1.0),
        (None, "nobody can name this text of a few words", "a", "x", 1.0),
        (6, "one", None, None, None),
        (7, LONG, "c", "x", 1.0),
        (8, "?!?! *** ---", "c", "x", 1.0),
        (8, "another text under a number that was given before", "c", "x", 1.0),
        (9, "Ünïcödé wörds ärê hérè — and “quotes” too 世界", "c", "x", 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, score double")
