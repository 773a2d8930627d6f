import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadloom.session import build_session, release, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        })
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    release(session)
    session.stop()
