import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string"


@pytest.fixture
def documents(spark):
    """Documents with two extra columns of clashing names."""

    def build(rows):
        filled = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows]
        return spark.createDataFrame(filled, COLUMNS)

    return build


@pytest.fixture
def odd(documents):
    """Nulls, empty and very long texts, repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, "a b c d e", "s1"), (1, "a b c d e", "s1"), (2, None, None), (3, "", "s2"), (None, "a b c d e", "s1"), (4, long, "s1"), (5, " \n ", None)]
    return documents(rows)
