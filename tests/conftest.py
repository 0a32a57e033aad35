import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from airloom.session import build_session, ensure_checkpoint_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("airloom-tests", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_folder(session)
    yield session
    session.stop()
