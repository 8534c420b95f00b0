import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from headway.session import get_session
    ck = tempfile.mkdtemp(prefix="headway-test-ckpt-")
    s = get_session("local[4]", 4, app_name="headway-tests", extra={
        "spark.checkpoint.dir": ck, "spark.driver.memory": "4g",
        "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield s


@pytest.fixture
def chunked():
    """Force every entity with more than 3 rows through the hot (chunked) path."""
    from headway.operators import sequence
    old = sequence.CHUNK_ROWS, sequence.PAIR_ROWS, sequence.PAIR_STRETCH
    sequence.CHUNK_ROWS = sequence.PAIR_ROWS = 3
    sequence.PAIR_STRETCH = 2
    yield
    sequence.CHUNK_ROWS, sequence.PAIR_ROWS, sequence.PAIR_STRETCH = old


SF = "/root/testdata/sf0.001"
