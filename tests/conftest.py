import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from palimpsest.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "3g")
    yield session
    session.stop()
