"""As-of join: each row with the newest row of another frame at or before its time."""

from pyspark.sql import DataFrame, Window, functions as F

MONTH = 30 * 24 * 3600


def asof_join(left: DataFrame, right: DataFrame, keys, time: str, name: str = "found",
              width: int = MONTH) -> DataFrame:
    """Left rows with `name`: the newest right row of equal `keys` at or before `time`, as a struct.

    The struct holds the right frame's other columns and its `time`; it is null where nothing is
    early enough or the left time is null.  Null keys equal each other.  Of right rows of one key
    and time the greatest counts; those without a time never do.

    Both sides meet in buckets of `width` seconds, so a key that holds most rows is cut along its
    time and no task sees a whole key.  What the newest right row before a bucket is crosses the
    border as one small row per bucket, over any number of buckets without right rows.
    """
    keys = list(keys)

    def at(df):
        return F.unix_micros(F.col(time).cast("timestamp")).alias("_at")

    def key(df):
        return F.struct(F.lit(0).alias("_all"), *[df[k] for k in keys]).alias("_key")

    values = [c for c in right.columns if c not in keys]
    later = right.filter(F.col(time).isNotNull()).select(
        key(right), at(right), F.struct(*values).alias("_value"))
    later = later.groupBy("_key", "_at").agg(F.max("_value").alias("_value"))
    rows = left.select(key(left), at(left), F.struct(*left.columns).alias("_row"))
    both = rows.withColumn("_value", F.lit(None).cast(later.schema["_value"].dataType)).unionByName(
        later.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    # rows without a time stand in a bucket before all others
    bucket = F.coalesce(F.floor(F.col("_at") / F.lit(width * 1_000_000)), F.lit(-(2 ** 62))).cast("long")
    both = both.withColumn("_bucket", bucket).repartition("_key", "_bucket")

    newest = both.groupBy("_key", "_bucket").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(
        "_key", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_at", F.col("_value").isNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return local.filter(F.col("_row").isNotNull()).join(carried, ["_key", "_bucket"]).select(
        "_row.*", F.coalesce("_local", "_carried").alias(name))
