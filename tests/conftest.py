import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadenza.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a data frame as a sorted list of tuples."""

    def read(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return read
