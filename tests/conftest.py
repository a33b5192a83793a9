import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tablewarden.session import build_session

    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    from compare import connect

    return connect(SMALL)


def rows(df, *columns):
    """Sorted tuples of a frame."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
