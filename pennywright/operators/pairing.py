"""One-to-one pairing of rows that share a natural key."""

from pyspark.sql import DataFrame, functions as F

from pennywright.operators.windows import number_within

NATURAL_KEY = ["statement_id", "date", "description", "amount"]


def pair_in_order(left: DataFrame, right: DataFrame, statements: DataFrame,
                  keys=tuple(NATURAL_KEY)) -> DataFrame:
    """Pair the i-th left row of a key with the i-th right row, both by id.

    `statements` maps left_id -> right_id of statements; left rows of an unmapped
    statement are left out.  A surplus left row stays with a null right_id.
    Numbering is block-wise, so a key repeated without end is no hot spot, and
    the joined (key, ordinal) is unique on both sides.
    """
    keys = list(keys)

    def natural(df):
        return df.withColumn("amount", F.round("amount", 4)).select("id", *keys)

    translated = (
        left.join(
            statements.filter("right_id IS NOT NULL").select(
                F.col("left_id").alias("statement_id"), "right_id"
            ),
            "statement_id",
        )
        .drop("statement_id")
        .withColumnRenamed("right_id", "statement_id")
    )
    ours = number_within(natural(translated), keys, "id").withColumnRenamed("id", "left_id")
    theirs = number_within(natural(right), keys, "id").withColumnRenamed("id", "right_id")
    # null parts of a key are equal, as any other value
    same = [F.col(f"ours.{k}").eqNullSafe(F.col(f"theirs.{k}")) for k in keys]
    same.append(F.col("ours.ordinal") == F.col("theirs.ordinal"))
    return ours.alias("ours").join(theirs.alias("theirs"), same, "left").select(
        "left_id", "right_id")
