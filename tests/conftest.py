from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]


@pytest.fixture(scope="session")
def spark():
    from lunario.session import build_session

    session = build_session("tests", cpus=8)
    yield session
    session.stop()
