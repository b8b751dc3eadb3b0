import pytest

from voltmes.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
