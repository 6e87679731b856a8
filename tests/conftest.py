import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from labelloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny_labels(spark):
    """Six rows, three labels: row 1 has none, row 2 has two, row 3 only the first."""
    wide = spark.createDataFrame(
        [(1, 0, 0, 0), (2, 0, 1, 1), (3, 1, 0, 0), (4, 0, 0, 1), (5, 0, 1, 0), (6, 0, 1, 0)],
        "id int, a int, b int, z int",
    )
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "pos int, label string")
    return wide, vocab
