import pytest

from strataweave.session import build_session, drop_scratch


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()
