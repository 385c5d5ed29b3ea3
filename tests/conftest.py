import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from evalspark.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="evalspark-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="evalspark-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="evalspark-test-")
