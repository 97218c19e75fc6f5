import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stormrail.session import build_session
    ckpt = tempfile.mkdtemp(prefix="stormrail-test-ckpt-")
    s = build_session("local[4]", app="stormrail-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
