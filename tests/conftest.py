import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradepost.functions.limits import LIMITS  # noqa: E402
from tradepost.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def limits():
    """Sizes that a test may set; they are put back afterwards."""
    before = dict(vars(LIMITS))
    yield LIMITS
    for name, value in before.items():
        setattr(LIMITS, name, value)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
