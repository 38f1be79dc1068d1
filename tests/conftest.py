import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tablesmith.session import session

    s = session("tests", {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"})
    yield s
    s.stop()
