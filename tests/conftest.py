import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from drivescope.session import session

    s = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.codegen.cache.maxEntries": "500"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
