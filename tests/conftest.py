import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from showgrid.session import build_session

    session = build_session("local[8]", 8, spark__driver__memory="8g", spark__sql__autoBroadcastJoinThreshold="10485760")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
