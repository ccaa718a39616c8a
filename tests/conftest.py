import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


OBSERVATION = "Area string, Item string, Year int, Element string, Unit string, Value double"


@pytest.fixture
def observe(spark):
    """Rows (Area, Item, Year, Element, Unit, Value) as an observation frame."""
    return lambda rows: spark.createDataFrame(rows, OBSERVATION)


@pytest.fixture
def sample(observe):
    return observe(
        [
            ("A", "Crop", 2024, "Production", "t", 10.0),
            ("A", "Crop", 2024, "Area harvested", "ha", 2.0),
            ("A", "Crop", 2024, "Yield", "kg/ha", 5000.0),
            ("B", "Crop", 2024, "Production", "t", 90.0),
            ("B", "Crop", 2024, "Area harvested", "ha", 3.0),
            ("B", "Crop", 2024, "Yield", "kg/ha", 30000.0),
        ]
    )
