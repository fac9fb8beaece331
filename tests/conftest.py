import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from massloom.session import get_spark

    tmp = tmp_path_factory.mktemp("spark")
    s = get_spark(4, **{"spark.sql.warehouse.dir": str(tmp / "warehouse"), "spark.checkpoint.dir": f"file://{tmp}/checkpoints", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
