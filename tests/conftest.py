import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pennywright.session import recommended
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield recommended(session)
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """values(list of texts, column function) -> list of results in order."""
    from pyspark.sql import functions as F

    def run(texts, fn):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i long, t string").select("i", fn(F.col("t")).alias("v"))
        return [r.v for r in df.orderBy("i").collect()]

    return run
