import pytest

from netspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session
