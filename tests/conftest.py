import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
