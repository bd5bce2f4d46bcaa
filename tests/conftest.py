import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from passbook.session import session

    s = session("passbook-tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                spark__ui__showConsoleProgress="false", spark__sql__maxMetadataStringLength="2000",
                spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
