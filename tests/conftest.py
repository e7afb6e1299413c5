import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from orrery.session import get_spark

    session = get_spark("local[4]", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
