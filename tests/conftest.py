import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Workers unpickle functions of the package and of these tests by name.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH")]))

from corpusgraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    """The smallest test tables; tests that need them are left out where they are absent."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder


def rows(df, *columns):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def got():
    return rows
