import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from tessel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()
