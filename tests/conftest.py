import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from intentspark.session import build_session
    ckpt = tempfile.mkdtemp(prefix="intentspark-test-ckpt-", dir="/tmp")
    wh = tempfile.mkdtemp(prefix="intentspark-test-wh-", dir="/tmp")
    s = build_session("local[4]", app="intentspark-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt, "spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="intentspark-test-", dir="/tmp")
