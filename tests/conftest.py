import pytest

from namewright.plans.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session("4", 4, "tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
