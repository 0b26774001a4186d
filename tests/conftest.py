"""One local session for all tests, with its shared folder in a directory of the test run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brepflow.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", 4, spark__driver__memory="3g", spark__checkpoint__dir=f"file://{shared}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect(config={"threads": 2})
    for name in os.listdir(small):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{small}/{name}'")
    return con
