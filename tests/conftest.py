import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliant.session import local_session

    return local_session("tests", "4", 4)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("FOLIANT_TEST_DATA", "/root/testdata/sf0.001")
