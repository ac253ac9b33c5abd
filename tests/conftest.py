import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codeloom.plans.workers import ship  # noqa: E402
from codeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    ship(session)
    yield session
    session.stop()
