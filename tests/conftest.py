import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session(4, shuffle_partitions=4, driver_memory="4g", spark__sql__session__timeZone="UTC")
    yield session
    session.stop()
