import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from meshwork.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
