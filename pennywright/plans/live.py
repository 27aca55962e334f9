"""Named queries over the live card feed.

Feed rows have transaction_id, date, merchant_name, signed amount (positive is
money out), category and pending.
"""

from pyspark.sql import DataFrame, functions as F

from pennywright.functions.money import dollars, feed_type
from pennywright.plans.common import capped, where
from pennywright.plans.registry import named


def month_to_date(as_of: str) -> tuple[str, str]:
    """Default date range: the first of the month to `as_of`."""
    return as_of[:8] + "01", as_of


def _chosen(feed: DataFrame, start, end, include_pending: bool = True) -> DataFrame:
    date = F.col("date")
    return where(
        feed,
        date >= F.lit(start).cast("date") if start else None,
        date <= F.lit(end).cast("date") if end else None,
        None if include_pending else ~F.col("pending"),
    )


def _spend(feed: DataFrame, key: str) -> DataFrame:
    return (
        feed.filter(feed_type(F.col("amount")) == "DEBIT")
        .groupBy(key)
        .agg(
            dollars(F.sum("amount")).alias("total_spent"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
    )


@named("live.by_category")
def by_category(feed: DataFrame, start_date=None, end_date=None,
                include_pending: bool = True) -> DataFrame:
    chosen = _chosen(feed, start_date, end_date, include_pending)
    return _spend(chosen, "category").orderBy(F.desc("total_spent"), "category")


@named("live.by_merchant")
def by_merchant(feed: DataFrame, start_date=None, end_date=None, limit: int = 20,
                include_pending: bool = True, cap: int | None = 100) -> DataFrame:
    chosen = _chosen(feed, start_date, end_date, include_pending)
    return (
        _spend(chosen, "merchant_name")
        .orderBy(F.desc("total_spent"), "merchant_name")
        .limit(capped(limit, cap))
    )


@named("live.rows")
def rows(feed: DataFrame, start_date=None, end_date=None, limit: int = 50,
         include_pending: bool = True, cap: int | None = 500) -> DataFrame:
    chosen = _chosen(feed, start_date, end_date, include_pending)
    return (
        chosen.select(
            "transaction_id", "date", "merchant_name",
            dollars(F.col("amount")).alias("amount"), "category",
            feed_type(F.col("amount")).alias("transaction_type"), "pending",
        )
        .orderBy(F.desc("date"), "transaction_id")
        .limit(capped(limit, cap))
    )


@named("live.summary")
def summary(feed: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """One row: totals, counts, and the category and merchant with most spend.

    One pass groups by (category, merchant); the rest works on those groups.
    """
    amount = F.col("amount")
    debit = feed_type(amount) == "DEBIT"
    groups = _chosen(feed, start_date, end_date).groupBy("category", "merchant_name").agg(
        F.sum(F.when(debit, amount)).alias("spent"),
        F.sum(F.when(~debit, amount)).alias("credits"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("pending"), 1)).alias("pending"),
    )
    by_key = groups.cube("category", "merchant_name").agg(
        F.grouping_id().alias("level"),
        F.sum("spent").alias("spent"),
        F.sum("credits").alias("credits"),
        F.sum("n").alias("n"),
        F.sum("pending").alias("pending"),
    )
    whole, category, merchant = (F.col("level") == v for v in (3, 1, 2))

    def top(name, level):
        best = F.when(level & F.col("spent").isNotNull(), F.struct("spent", name))
        return F.max(best).getField(name)

    return by_key.filter("level <> 0").agg(
        F.lit(start_date).alias("period_start"),
        F.lit(end_date).alias("period_end"),
        F.coalesce(F.max(F.when(whole, dollars(F.col("spent")))), F.lit(0.0))
        .alias("total_spent"),
        F.coalesce(F.max(F.when(whole, dollars(F.abs("credits")))), F.lit(0.0))
        .alias("total_credits"),
        F.coalesce(F.max(F.when(whole, dollars(
            F.coalesce("spent", F.lit(0)) + F.coalesce("credits", F.lit(0))))), F.lit(0.0))
        .alias("net_spend"),
        F.coalesce(F.max(F.when(whole, F.col("n"))), F.lit(0)).alias("transaction_count"),
        F.coalesce(F.max(F.when(whole, F.col("pending"))), F.lit(0)).alias("pending_count"),
        top("category", category).alias("top_category"),
        top("merchant_name", merchant).alias("top_merchant"),
    )
