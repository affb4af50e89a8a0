import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

import variorum  # noqa: E402
from variorum.session import session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark__sql__shuffle__partitions": "4", "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared"))}
    found = session("tests", "local[4]", **conf)
    found.sparkContext.setLogLevel("ERROR")
    variorum.ship(found)
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{TESTDATA}/sf0.001"
