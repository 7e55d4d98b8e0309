import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from prefloom.session import build_session, checkpoint_dir, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "8g")
    prepare(session)
    checkpoint_dir(session)
    yield session
    session.stop()
