from __future__ import annotations

import pytest

from factloom.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    ship_package(session)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
