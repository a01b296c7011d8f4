import pytest

from urbanloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    if not session.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
