"""What the operators share: the shared folder, word splitting, small helpers."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Word and separator characters of the query contracts.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is `spark.checkpoint.dir` where the session names one, else a folder
    beside the session's tables (as in tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named or spark.conf.get("spark.sql.warehouse.dir") + "/llm-stages"
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a new Parquet table in the shared folder, read back.

    Cuts the lineage: what is read again after a lost executor is a file.
    """
    path = f"{shared_base(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A narrow written table, marked for broadcast if it has at most `most_rows` rows.

    Beyond that the join is left to Spark, which shuffles both sides.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
