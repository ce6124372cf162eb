"""One Spark session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from foliospark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    session = build_session("tests", cpus=4, shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
