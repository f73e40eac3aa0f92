import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from legible.session import build_session
    s = build_session("local[4]", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):       # tests only: a scratch folder of our own
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="legible-test-ckpt-"))
    yield s
    s.stop()


SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"
