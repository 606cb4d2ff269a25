import logging
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stopflow.session import build_session
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from compare import connect
    return connect(FOLDER)


@pytest.fixture()
def new_path(tmp_path):
    def make(name):
        return str(tmp_path / name)
    return make
