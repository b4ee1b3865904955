import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sentences(spark):
    """Build a sentence table from (words, tags[, guesses]) tuples."""

    def build(*rows):
        columns = ["words", "tags", "guesses"][: len(rows[0])]
        schema = "sent_id bigint, " + ", ".join(f"{c} array<string>" for c in columns)
        return spark.createDataFrame([(i + 1, *map(list, row)) for i, row in enumerate(rows)], schema)

    return build


@pytest.fixture
def weights(spark):
    def build(values):
        return spark.createDataFrame([(f, float(w)) for f, w in values.items()], "feature string, weight double")

    return build
