import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from staylens.session import get_session
    scratch = tempfile.mkdtemp(prefix="staylens-test-")
    s = get_session("local[4]", 8, extra={"spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    yield s
    s.stop()


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="staylens-run-")
