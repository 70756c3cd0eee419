import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rollweave.session import local_session

    session = local_session("4", 4, str(tmp_path_factory.mktemp("scratch")))
    yield session
    session.stop()
