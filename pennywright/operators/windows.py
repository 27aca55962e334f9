"""Ordered-row operators that stay balanced when one group is huge.

A plain window puts a whole group into one task.  Here a group is cut into
blocks of its order column; the work happens inside blocks, and only one small
row per block crosses block borders.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1_000_000


def _cut(df: DataFrame, keys, order: str, width: int) -> DataFrame:
    """Rows with their key as one struct and their block, shuffled by both.

    A struct is never null and equal where its null parts are, so rows with null key parts
    stay; rows without an order value are a block of their own.  As neither column can be
    null, both uses of the exchange are alike and Spark runs it once.
    """
    block = F.coalesce(F.expr(f"`{order}` div {width}L"), F.lit(-1).cast("long"))
    cut = df.withColumns({"_key": F.struct(*keys), "_block": block})
    return cut.repartition("_key", "_block")


def number_within(df: DataFrame, keys, order: str, name: str = "ordinal",
                  width: int = BLOCK) -> DataFrame:
    """Number rows 1, 2, 3 ... within `keys` by a unique whole-number `order`.

    Null key parts are equal to each other.  Rows shuffle once, by key and block: numbering,
    counting and the join with the small offsets all use that one exchange.
    """
    cut = _cut(df, keys, order, width)
    sizes = cut.groupBy("_key", "_block").agg(F.count(F.struct(order)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "_key", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_key", "_block").orderBy(order)
    numbered = cut.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(offsets, ["_key", "_block"]).select(
        *df.columns, (F.col("_before") + F.col("_rn")).cast("long").alias(name)
    )


def carry_forward(df: DataFrame, keys, order: str, marks: dict[str, Column],
                  width: int = BLOCK, before: bool = False) -> DataFrame:
    """Add, per mark, its last non-null value at or above each row of the group.

    With `before`, the row's own value does not count.  `order` is a unique
    whole number within the group; null key parts are equal to each other.

    Rows shuffle once, by key and block.  The block summary takes the last
    marked row as a whole, so that it reads the same columns and Spark reuses
    the exchange instead of computing the input again.
    """
    names = list(marks)
    cut = _cut(df.withColumns({f"_m_{n}": c for n, c in marks.items()}), keys, order, width)
    whole = F.struct(*cut.columns)
    blocks = cut.groupBy("_key", "_block").agg(*[
        F.max_by(whole, F.when(F.col(f"_m_{n}").isNotNull(), F.col(order))).alias(f"_b_{n}")
        for n in names
    ]).select("_key", "_block", *[F.col(f"_b_{n}._m_{n}").alias(f"_b_{n}") for n in names])
    above = Window.partitionBy("_key").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = blocks.select(
        "_key", "_block",
        *[F.last(f"_b_{n}", ignorenulls=True).over(above).alias(f"_c_{n}") for n in names],
    )
    inside = Window.partitionBy("_key", "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if before else Window.currentRow
    )
    local = cut.withColumns(
        {f"_l_{n}": F.last(f"_m_{n}", ignorenulls=True).over(inside) for n in names}
    )
    return local.join(carried, ["_key", "_block"]).select(
        *df.columns,
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in names],
    )


def latest_rows(df: DataFrame, keys, order: str) -> DataFrame:
    """Rows at the greatest `order` of their group, all ties kept.

    The maxima are one small pre-aggregated row per group, so the rows
    themselves need no window and no sort.
    """
    keys = list(keys)
    newest = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(newest, keys + [order], "left_semi")


def latest_rows_by_rank(df: DataFrame, keys, order: str) -> DataFrame:
    """The same by rank() = 1; Spark limits each group before it shuffles."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_rows(df: DataFrame, keys, order, n: int) -> DataFrame:
    """The last `n` rows of each group; groups are cut to `n` before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def change_over(series: DataFrame, keys, order: str, value: str, periods: int) -> DataFrame:
    """Percent change against `periods` rows earlier in each (short) series."""
    w = Window.partitionBy(*keys).orderBy(order)
    earlier = F.lag(value, periods).over(w)
    return series.withColumn(
        "pct_change", (F.col(value) - earlier) / F.nullif(earlier, F.lit(0.0)) * 100
    )


def dense_ids(df: DataFrame, hash_column: str, start: Column | int = 0, name: str = "id",
              prefix: int = 4, most: int = None) -> DataFrame:
    """Ids start+1, start+2, ... in the order of a unique hex digest column.

    A digest is evenly spread, so its first characters cut the rows into even
    blocks; one count per block (at most 16^prefix rows) gives the offsets.
    Where `most` says that all rows together are no more than a block, one task
    numbers them and they are read once.
    """
    if most is not None and most <= BLOCK:
        place = F.row_number().over(Window.orderBy(hash_column))
        return df.withColumn(name, (F.lit(start) + place).cast("long"))
    cut = df.withColumn("_block", F.substring(hash_column, 1, prefix))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_block").orderBy(hash_column)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_block")
        .withColumn(name, (F.lit(start) + F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_block", "_rn", "_before")
    )
