import pytest

from trailsift.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "tests")
    yield session
    session.stop()
