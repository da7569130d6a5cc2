import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tablewarden.session import local_session

    return local_session("tests", cores=8)


@pytest.fixture(scope="session")
def duck():
    from catalog.compare import connect

    return connect(SMALL)
