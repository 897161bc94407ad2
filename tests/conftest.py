"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = os.pathsep.join([str(REPO), os.environ.get("PYTHONPATH", "")])

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from evalmill.session import local_session

    session = local_session("8", partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir() -> str:
    if not DATA.is_dir():
        pytest.skip("the driver's tables aren't here")
    return str(DATA)
