import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyspark.session import local_session, ship

    os.environ.setdefault("TALLYSPARK_SHARED", str(tmp_path_factory.mktemp("shared")))
    s = local_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()
