import pytest

from loomspan.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared").as_uri()
    session = build_session(master="local[4]", app="tests", shuffle_partitions=4, **{"spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    return session
