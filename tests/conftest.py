import os

import pytest
from pyspark.sql import SparkSession

from docweft.session import SESSION_CONF


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    found = SparkSession.builder.master("local[4]").config(map=SESSION_CONF | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def data():
    """Folder of the smallest test tables."""
    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("test tables are not here")
    return where
