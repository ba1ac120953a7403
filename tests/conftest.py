import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from canopy.session import get_spark
    d = tempfile.mkdtemp(prefix="canopy-test-", dir="/tmp")
    s = get_spark(master="local[*]", shuffle_partitions=8, extra={
        "spark.driver.memory": "8g", "spark.sql.warehouse.dir": f"{d}/warehouse", "spark.checkpoint.dir": f"{d}/checkpoints"})
    s.sparkContext.setCheckpointDir(f"{d}/checkpoints")
    yield s


@pytest.fixture()
def tmp_dir(spark):
    from canopy.session import scratch_path
    return scratch_path(spark, "test")
