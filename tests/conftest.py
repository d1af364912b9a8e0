import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scriptorium.session import build_session

    session = build_session("local[4]", shuffle_partitions=4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
