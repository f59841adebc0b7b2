import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fareflow.session import local_session
    s = local_session(cores=4, shuffle_partitions=8, app="fareflow-tests")
    yield s
    s.stop()
