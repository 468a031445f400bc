import pytest

from docflow import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
