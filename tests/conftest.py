import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from basketlens.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="basketlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck01():
    from tests.compare import duck_views

    return duck_views(SF01)
