import os

import pytest
from hypothesis import settings

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
settings.register_profile("shared machine", deadline=None)
settings.load_profile("shared machine")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    settings = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
