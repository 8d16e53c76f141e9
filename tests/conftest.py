import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from voltaic.session import session

    out = session("tests", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
