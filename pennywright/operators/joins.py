"""Joins that hold up when one key owns a large part of the rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

PARTS = 512


def compute_once(df: DataFrame, keys, compute: Callable[[DataFrame], DataFrame], spread: str,
                 parts: int = PARTS) -> DataFrame:
    """Attach `compute(distinct keys)` to every row, computing each key once.

    Keys are counted before the shuffle.  Every key with more than 1 / `parts` of all rows
    is split over `parts` salts by a hash of the `spread` column and its result repeated per
    salt; all other keys join as they are.  There are fewer than `parts` such keys whatever the
    data, so their list is broadcast.  Keys are not null.
    """
    keys = list(keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_freq"))
    total = counted.agg(F.sum("_freq")).scalar()
    hot = counted.filter(F.col("_freq") * parts > total).select(*keys, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    results = compute(counted.drop("_freq")).join(hot, keys, "left")
    results = results.withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    ).drop("_hot")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    rows = df.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    return rows.drop("_hot").join(results, keys + ["_salt"], "left").drop("_salt")


def registry_map(left: DataFrame, right: DataFrame, key: str = "file_hash") -> DataFrame:
    """Left id -> right id through a shared key; unmatched left ids keep a null."""
    return left.select(F.col("id").alias("left_id"), key).join(
        right.select(F.col("id").alias("right_id"), key), key, "left"
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-null) key has no parent."""
    parents = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")


def not_yet_enriched(raw: DataFrame, enriched: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Raw rows without an enriched row of at least `threshold` confidence."""
    done = enriched.filter(F.col("confidence_score") >= threshold).select(
        F.col("raw_id").alias("id")
    )
    return raw.join(done, "id", "left_anti")
