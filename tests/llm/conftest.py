import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null id, a repeated row, one very long text, columns with working names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", 1, "x"),
        (1, "one two three four five six seven eight nine ten eleven", 1, "x"),
        (2, None, None, None),
        (3, "", 2, "y"),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 3, "z"),
        (4, long, 4, "z"),
        (5, "  \t\n ", 5, "z"),
        (6, "very short", 6, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, row string")


@pytest.fixture(scope="session")
def few_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
