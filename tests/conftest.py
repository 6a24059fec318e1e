import pytest

from tessellon.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=4, shuffle_partitions=4)
