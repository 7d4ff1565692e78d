import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
ALLOY_CSV = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "alloys.csv")   # 200 rows


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("fathom-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathom-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def alloy(spark):
    from fathom.sources.csv import csv_source
    return csv_source(spark, ALLOY_CSV).cache()
