"""Where jobs put intermediate tables: the shared folder the cluster names."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or beside the session's tables where it is unset.

    Both are folders that driver and executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir") + "/stages")
    return f"{base.rstrip('/')}/pennywright-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written out and read back: lineage is cut, executors may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
