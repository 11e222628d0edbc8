import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from matchloom.session import local_session

    s = local_session(cpus="8", partitions=8, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
