import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tiltlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tiltlab-tests", 4)
    yield session
    session.stop()


@pytest.fixture
def day():
    return lambda text: dt.date.fromisoformat(text)
