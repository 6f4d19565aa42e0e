import os

import pytest

# many short plans: the first compiler tier starts fastest
os.environ.setdefault("JDK_JAVA_OPTIONS", "-XX:TieredStopAtLevel=1")

from energylake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "energylake-tests", str(tmp_path_factory.mktemp("shared")))
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()
