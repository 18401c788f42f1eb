import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from jobsignal.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="jobsignal-tests", driver_memory="4g")
    yield s
    s.stop()
