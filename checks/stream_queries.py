"""Streams over files derived from the driver's tables, run until they are caught up."""

from pyspark.sql import functions as F

from checks import rules_sql as sql
from checks.catalog import add
from checks.ledger_queries import money_out
from checks.views import card_feed, ledger
from pennywright.functions import fixed_values as fv
from pennywright.operators import enrich
from pennywright.operators.keyed_table import KeyedTable
from pennywright.plans import live
from pennywright.sources import scratch
from pennywright.streaming import batches, enrichment, feed as feed_stream, folder



ROWS_PER_FILE = 2500


def imported(spark, sf_dir):
    """Files of a bounded number of ledger ids; the same files again under other names."""
    base = scratch.shared_folder(spark)
    rows = ledger(spark, sf_dir).select(
        F.expr(f"id div {ROWS_PER_FILE}").alias("part"), F.col("id").cast("string").alias("value"))
    for copy in ("first", "second"):
        rows.repartition("part").sortWithinPartitions("part", "value").write.partitionBy(
            "part").text(f"{base}/in/{copy}")
    folder.import_folder(spark, f"{base}/in", f"{base}/registry", f"{base}/cp",
                         files_per_batch=4).awaitTermination()
    found = batches.read_batches(spark, f"{base}/registry", folder.REGISTRY)
    return found.agg(F.count(F.lit(1)).alias("n_statements"), F.min("id").alias("first_id"),
                     F.max("id").alias("last_id"),
                     F.countDistinct("file_hash").alias("n_hashes"))


add("st1_folder_stream", imported, f"""
WITH parts AS (SELECT COUNT(DISTINCT id // {ROWS_PER_FILE}) AS n FROM ledger)
SELECT n AS n_statements, CAST(1 AS BIGINT) AS first_id, n AS last_id, n AS n_hashes
FROM parts""", "ledger")


def raw_twice(spark, sf_dir, base):
    """Raw rows in two drops; the second one corrects every third description."""
    rows = ledger(spark, sf_dir)
    rows.write.parquet(f"{base}/raw/drop=1")
    again = rows.filter("id % 3 = 0").withColumn("description", F.lit("VENMO PAYMENT"))
    again.write.parquet(f"{base}/raw/drop=2")
    return rows.schema


def streamed_enrichment(spark, sf_dir):
    base = scratch.shared_folder(spark)
    schema = raw_twice(spark, sf_dir, base)
    for drop in (1, 2):
        stream = spark.readStream.schema(schema).parquet(f"{base}/raw/drop={drop}")
        # one checkpoint per drop; batch numbers go on in the log
        log = f"{base}/log"
        enrichment.enrich_stream(
            stream, enrich.enrich_bank, f"{log}/run={drop}", f"{base}/cp{drop}"
        ).awaitTermination()
    done = spark.read.parquet(log).withColumn("_run", F.col("run"))
    return money_out(batches.current_rows(done.drop("run"), "raw_id", "_run", "batch_id")
                     .drop("_run"))


BANK = sql.contains_case("upper(what)", fv.BANK_CATEGORIES, "'Uncategorized'")
add("st2_enrichment_stream", streamed_enrichment, f"""
WITH r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'VENMO PAYMENT' ELSE description END AS what
  FROM ledger)
SELECT raw_id, statement_id, bank_name, account_type, date, what AS description,
  {sql.clean_bank('what')} AS clean_description, CAST(amount AS DOUBLE) AS amount,
  transaction_type, CAST(balance AS DOUBLE) AS balance, {BANK} AS category,
  CAST(CASE WHEN ({BANK}) = 'Uncategorized' THEN 0.3 ELSE 1.0 END AS DOUBLE) AS confidence_score,
  CASE WHEN ({BANK}) = 'Uncategorized' THEN 'fallback' ELSE 'rule_based' END
    AS enrichment_method FROM r""", "ledger")


def feed_rows(spark, sf_dir):
    return card_feed(spark, sf_dir).select(
        "transaction_id", F.col("ts").cast("timestamp").alias("ts"), "date", "merchant_name",
        "amount", "category", "pending")


def month_to_date(spark, sf_dir):
    """Pending rows come first with half the amount; posted ones replace some of them."""
    base = scratch.shared_folder(spark)
    rows = feed_rows(spark, sf_dir)
    early = rows.filter("transaction_id % 2 = 0").withColumns({
        "pending": F.lit(True), "amount": (F.col("amount") / 2).cast("decimal(18,2)")})
    late = rows.filter("transaction_id % 4 <> 2").withColumn("pending", F.lit(False))
    early.unionByName(late).write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(feed_stream.FEED).option("maxFilesPerTrigger", 2).parquet(
        f"{base}/feed")
    feed_stream.land_feed(stream, f"{base}/log", f"{base}/cp").awaitTermination()
    now = feed_stream.current_feed(spark, f"{base}/log")
    return live.by_category(now, "2024-01-01", "2024-01-31")


add("st3_month_to_date_stream", month_to_date, """
WITH now AS (SELECT category, CASE WHEN transaction_id % 4 = 2
    THEN CAST((CAST(amount * 100 AS HUGEINT) + CASE WHEN amount < 0 THEN -1 ELSE 1 END) // 2
      AS DOUBLE) / 100 ELSE CAST(amount AS DOUBLE) END AS amount, amount >= 0 AS debit,
    date FROM card_feed)
SELECT category, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
  COUNT(*) AS transaction_count FROM now
WHERE debit AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY category""",
    "card_feed")


def running_totals(spark, sf_dir):
    """The feed of the month to date, totals kept as it comes: pending rows, then posted ones."""
    base = scratch.shared_folder(spark)
    rows = feed_rows(spark, sf_dir)
    early = rows.filter("transaction_id % 2 = 0").withColumns({
        "pending": F.lit(True), "amount": (F.col("amount") / 2).cast("decimal(18,2)")})
    late = rows.filter("transaction_id % 4 <> 2").withColumn("pending", F.lit(False))
    held = KeyedTable(spark, f"{base}/held", "transaction_id", buckets=max(8, rows.count() // 200_000))
    for part in (early, late, early.limit(0)):
        part.write.mode("append").parquet(f"{base}/feed")
        stream = spark.readStream.schema(feed_stream.FEED).option("maxFilesPerTrigger", 2).parquet(
            f"{base}/feed")
        feed_stream.running_totals(stream, held, f"{base}/totals", f"{base}/cp", fan=2).awaitTermination()
    return feed_stream.month_totals(spark, f"{base}/totals")


add("st3_running_totals", running_totals, """
WITH now AS (SELECT category, CASE WHEN transaction_id % 4 = 2
    THEN CAST((CAST(amount * 100 AS HUGEINT) + CASE WHEN amount < 0 THEN -1 ELSE 1 END) // 2
      AS DOUBLE) / 100 ELSE CAST(amount AS DOUBLE) END AS amount, amount >= 0 AS debit,
    strftime(date, '%Y-%m') AS month FROM card_feed)
SELECT month, category, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
  COUNT(*) AS transaction_count FROM now WHERE debit GROUP BY month, category""", "card_feed")


def daily_stream(spark, sf_dir):
    """Daily totals of a feed whose rows arrive twice; the last days stay open."""
    base = scratch.shared_folder(spark)
    rows = feed_rows(spark, sf_dir)
    rows.unionByName(rows.filter("transaction_id % 5 = 0")).write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(feed_stream.FEED).parquet(f"{base}/feed")
    totals = feed_stream.daily_totals(stream).select(
        F.col("day.start").cast("date").alias("day"), "category", "total_spent",
        "transaction_count")
    (totals.writeStream.format("parquet").option("path", f"{base}/out")
     .option("checkpointLocation", f"{base}/cp").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{base}/out")


add("st3_daily_stream", daily_stream, """
SELECT date AS day, category, CAST(SUM(amount) AS DOUBLE) AS total_spent,
  COUNT(*) AS transaction_count FROM card_feed
WHERE amount >= 0 AND date + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM card_feed)
GROUP BY date, category""", "card_feed")
