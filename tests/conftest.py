import pytest

from clipsieve.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
