import pytest

LONG = "id long, doc_id long, text string, score string, component_id int"
NASTY = [None, "", " \t\n", "a", "one two", "é ü x", "</s> <|endoftext|> [INST]", "w " * 3000, "x" * 5000, "the same words again and again\n" * 40]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(i, i, t, "clash", 7) for i, t in enumerate(NASTY)] + [(3, 3, "a", "clash", 7), (99, None, "a", None, None)]
    return spark.createDataFrame(rows, LONG)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], LONG)
