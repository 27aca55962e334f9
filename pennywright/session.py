"""Session settings the queries are written for."""

from pyspark.sql import SparkSession

RECOMMENDED = {
    # fall back to split projections where a generated method is too long for the JIT
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def recommended(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark
