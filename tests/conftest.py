import pytest

from millrace.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
