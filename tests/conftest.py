import tempfile

import pytest
from pyspark.sql import SparkSession

from roundledger import configure


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="warehouse-")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("roundledger-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", warehouse)
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()
