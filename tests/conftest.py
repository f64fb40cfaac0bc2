import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from dialsieve.session import configure
    s = (SparkSession.builder.master("local[*]").appName("dialsieve-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dialsieve-test-ckpt-"))
    configure(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="dialsieve-test-")


def strings(spark, rows, cols):
    """Small all-string frame (test fixture helper)."""
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))
