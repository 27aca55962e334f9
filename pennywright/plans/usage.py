"""Named queries over conversations and the assistant's usage log."""

from pyspark.sql import DataFrame, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.conversation import cache_key, cost, role_label
from pennywright.operators.windows import last_rows
from pennywright.plans.registry import named

HISTORY = 6


def price_table(spark) -> DataFrame:
    """Model prices: seven fixed rows, so always small enough to broadcast."""
    rows = [(m, i, o) for m, (i, o) in fv.MODEL_PRICES.items()]
    return spark.createDataFrame(rows, "model string, price_in double, price_out double")


@named("usage.with_cost")
def with_cost(log: DataFrame) -> DataFrame:
    prices = F.broadcast(price_table(log.sparkSession))
    return log.join(prices, "model", "left").withColumn(
        "cost_usd",
        cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"),
             F.col("price_out")),
    ).drop("price_in", "price_out")


@named("usage.rollup")
def rollup(log: DataFrame, keys=("session",)) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("cost_usd").alias("total_cost_usd"),
    )


@named("usage.recent_turns")
def recent_turns(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last `n` turns of every conversation."""
    return last_rows(turns, ["conv_id"], ["turn"], n)


@named("usage.prompts")
def prompts(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """One prompt text per conversation from its last `n` turns, oldest first."""
    labelled = recent_turns(turns, n).withColumn("label", role_label(F.col("role")))
    lines = F.struct("turn", F.concat_ws(": ", "label", "text").alias("line"))
    return (
        labelled.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), lines)))
             .alias("lines"))
        .select(
            "conv_id",
            F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("prompt"),
        )
    )


@named("usage.distinct_prompts")
def distinct_prompts(calls: DataFrame) -> DataFrame:
    """One row per cache key with its uses: what a response cache would keep."""
    keyed = calls.withColumn(
        "cache_key", cache_key(F.col("model"), F.col("system"), F.col("prompt"))
    )
    return keyed.groupBy("cache_key").agg(F.count(F.lit(1)).alias("uses"))
