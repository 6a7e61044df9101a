import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from clickloom.session import build  # noqa: E402
from clickloom.sources.demo import Demo  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build(8, 8, "tests")
    yield session
    session.stop()


@pytest.fixture()
def demo(spark):
    return Demo(spark, FOLDER)
