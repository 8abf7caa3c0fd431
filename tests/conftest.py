import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kinweave.session import build_session, clear_working  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "kinweave-tests", "local[8]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="kinweave-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_working(session)
    session.stop()
