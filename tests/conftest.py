import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    d = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"{d}/checkpoint", "spark.sql.warehouse.dir": f"{d}/warehouse"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    yield session
    session.stop()
