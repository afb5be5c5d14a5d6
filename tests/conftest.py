from __future__ import annotations

import pytest

from tallyweave.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
