import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stowage.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole filters in plan checks
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
