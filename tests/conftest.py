import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tideline.session import build_session, configure

    session = build_session(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            # Short plans: the second compiler tier costs more than it returns.
            "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()
