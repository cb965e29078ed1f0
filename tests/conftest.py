import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from trivalent.session import get_spark

    session = get_spark("tests", cpus=8, **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})
    yield session
    session.stop()
