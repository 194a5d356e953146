import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from noticemill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
