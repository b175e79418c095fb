import pytest

from quillgraph.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=4, name="tests")
    yield s
    s.stop()
