import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sombra.functions.hashing import MaskKey  # noqa: E402
from sombra.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="sombra-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def key():
    return MaskKey(b"unit-test-key")
