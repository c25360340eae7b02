import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tessera-test-")


@pytest.fixture(autouse=True)
def readers_as_before():
    """Readers that a test registers are gone after it."""
    from tessera.sources import readers
    before = dict(readers._READERS)
    yield
    readers._READERS.clear()
    readers._READERS.update(before)
