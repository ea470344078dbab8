from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from marlstone.sources.deploy import ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def session(spark):
    from marlstone.session import Session

    return Session(spark)
