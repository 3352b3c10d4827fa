import pytest

from sievework.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
