import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from frameloom.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_session():
    spark = build_session(
        "frameloom-tests",
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="frameloom-tests-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


test_session.__test__ = False


@pytest.fixture(scope="session")
def spark():
    return test_session()


@pytest.fixture(scope="session")
def sf():
    return SF
