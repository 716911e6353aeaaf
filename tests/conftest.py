import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rivalry.session import local_session

    s = local_session(4, "rivalry-tests", "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
