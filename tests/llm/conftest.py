import pytest

SCHEMA = "doc_id bigint, text string, n_chars bigint, KEPT string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (1, None, None, "x", None), (2, "", 0, None, "y"), (3, " \n\t ", 4, "x", "y"), (4, long, len(long), None, None), (5, "a b c d e f g", 13, "x", "y"), (6, "a b c d e f g", 13, "x", "y"),
        (7, "A  B c\nd e f g", 14, "x", "y"), (8, "été naïve 日本語 " * 30, None, "x", "y"), (9, "x" * 50_000, 50_000, None, None), (10, "l1\nl2\nl3\nl4", 11, "x", "y"), (11, "z\nl1\nl2\nl3\nl4\nq", 15, "x", "y"), (11, "z\nl1\nl2\nl3\nl4\nq", 15, "x", "y"),
        (None, "a b c d e f g", 13, "x", "y"), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
