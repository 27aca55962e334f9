"""The card feed as a stream: daily totals, and pending rows giving way to posted."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pennywright.functions.money import MONEY, dollars, feed_type
from pennywright.operators.keyed_table import KeyedTable
from pennywright.operators.tables import upsert_rows
from pennywright.streaming.batches import (
    FAN, compact, newest_rows, read_log, run_available, write_batch,
)

FEED = f"""transaction_id long, ts timestamp, date date, merchant_name string, amount {MONEY},
category string, pending boolean"""


def daily_totals(feed: DataFrame, late: str = "2 days") -> DataFrame:
    """Debit totals per day and category; rows sent twice count once.

    State is kept for `late` event time only, then a day is final.
    """
    once = feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["transaction_id"])
    spent = once.filter(feed_type(F.col("amount")) == "DEBIT")
    return spent.groupBy(F.window("ts", "1 day").alias("day"), "category").agg(
        dollars(F.sum("amount")).alias("total_spent"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


COLUMNS = [f.split()[0] for f in FEED.replace("decimal(18,2)", "d").split(",")]


def _current(rows: DataFrame) -> DataFrame:
    """One row per transaction: posted beats pending, later beats earlier; batch_id stays."""
    marked = rows.withColumn("_posted", ~F.col("pending"))
    return newest_rows(marked, "transaction_id", "_posted", "batch_id").drop("_posted")


def land_feed(feed: DataFrame, log: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Append feed rows to a batch-keyed log, which is compacted."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select(*COLUMNS), log, batch_id)
        compact(batch.sparkSession, log, FEED, _current, batch_id, fan)

    return run_available(feed, each, checkpoint)


def current_feed(spark: SparkSession, log: str) -> DataFrame:
    """One row per transaction: a posted row replaces a pending one, later beats earlier."""
    return _current(read_log(spark, log, FEED)).drop("batch_id")


TOTALS = f"month string, category string, total_spent {MONEY}, transaction_count long"


def _contribution(rows: DataFrame, sign: int) -> DataFrame:
    """What rows add to (or take from) the totals of their month and category: debits only."""
    return rows.filter(feed_type(F.col("amount")) == "DEBIT").select(
        F.date_format("date", "yyyy-MM").alias("month"), "category",
        (F.col("amount") * sign).cast(MONEY).alias("total_spent"),
        F.lit(sign).cast("long").alias("transaction_count"))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("month", "category").agg(
        F.sum("total_spent").cast(MONEY).alias("total_spent"),
        F.sum("transaction_count").alias("transaction_count"), F.max("batch_id").alias("batch_id"))


def running_totals(feed: DataFrame, held: KeyedTable, totals: str, checkpoint: str,
                   fan: int = FAN) -> StreamingQuery:
    """Keep monthly totals by category that follow every change of a transaction.

    `held` has the current row of each transaction.  A batch reads the buckets of its own
    transactions, takes what their old rows counted out of the totals and puts in what the new ones
    count: a pending row's amount goes when the posted one comes, in whatever month that is.  The
    changes are written before the table commits the batch, and a batch that the table has is
    skipped, so each counts once however often it runs.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not held.versions():
            held.create(spark.createDataFrame([], FEED))
        if held.state().get("note", {}).get("batch", -1) < batch_id:
            come = batch.select(*COLUMNS).withColumn("batch_id", F.lit(batch_id).cast("long"))
            old = held.lookup(come.select("transaction_id")).select(*COLUMNS).withColumn(
                "batch_id", F.lit(-1).cast("long"))
            now = _current(old.unionByName(come))
            deltas = _contribution(old, -1).unionByName(_contribution(now, 1)).withColumn(
                "batch_id", F.lit(batch_id).cast("long"))
            write_batch(_summed(deltas).drop("batch_id"), totals, batch_id)
            held.upsert(now.select(*COLUMNS), upsert_rows, note={"batch": batch_id})
        compact(spark, totals, TOTALS, _summed, batch_id, fan)

    return run_available(feed, each, checkpoint)


def month_totals(spark: SparkSession, totals: str) -> DataFrame:
    """month, category, total_spent and transaction_count: merged levels plus the latest batches."""
    rows = _summed(read_log(spark, totals, TOTALS)).filter("transaction_count <> 0")
    return rows.select("month", "category", dollars(F.col("total_spent")).alias("total_spent"),
                       "transaction_count")
