import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
    for k, v in (("spark.ui.enabled", "false"), ("spark.sql.session.timeZone", "UTC"), ("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))), ("spark.ui.showConsoleProgress", "false"), ("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")):
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture
def root(spark, tmp_path):
    from quillstone.store import Root

    with Root(spark, str(tmp_path / "store")) as r:
        yield r
