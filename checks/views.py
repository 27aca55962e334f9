"""The driver's tables in ledger shape: DataFrames for Spark, SELECTs for SQL.

Every view takes date bounds on the raw timestamp, so that a query over a
period prunes the parquet scan before anything is computed.
"""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

ORDERS_AS_OF = "1999-07-15"
EVENTS_AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _between(df, column, since, until):
    """Rows from `since` (inclusive) to `until` (exclusive)."""
    if since:
        df = df.filter(F.col(column) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        df = df.filter(F.col(column) < F.lit(until).cast("timestamp_ntz"))
    return df


def _pick(key, modulus, *values, otherwise):
    case = None
    for i, value in enumerate(values):
        test = F.col(key) % modulus == i
        case = F.when(test, value) if case is None else case.when(test, value)
    return case.otherwise(otherwise)


def ledger(spark, sf_dir, since=None, until=None) -> DataFrame:
    orders = _between(table(spark, sf_dir, "orders"), "o_orderdate", since, until)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    starbucks = F.concat(
        F.lit("STARBUCKS STORE "), (key + 10000).cast("string"), F.lit(" SEATTLE WA")
    )
    return orders.select(
        key.alias("id"),
        key.alias("raw_id"),
        (cust % 40).alias("statement_id"),
        _pick("o_orderkey", 4, "capital_one", "citi", "bofa", otherwise="robinhood")
        .alias("bank_name"),
        F.when(key % 3 == 0, "savings").otherwise("checking").alias("account_type"),
        F.col("o_orderdate").cast("date").alias("date"),
        _pick("o_orderkey", 12, "AMZN*MKTP US*2K4F9 SEATTLE WA", starbucks,
              "WHOLEFDS #10234 AUSTIN TX", "SHELL OIL 57444780203 HOUSTON TX",
              "NETFLIX.COM 866-579-7172 CA", "PAYROLL DIRECT DEP",
              "ACH DEBIT EVERSOURCE ENERGY", "TRANSFER FROM CHECKING",
              "ROBINHOOD DES:FUNDS", "ATM WITHDRAWAL CHASE BANK NYC",
              "CIRCUIT CITY 2341 RICHMOND VA", otherwise="STOP   &   SHOP 12345")
        .alias("description"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(status == "F", "DEBIT").when(status == "O", "CREDIT").otherwise("UNKNOWN")
        .alias("transaction_type"),
        F.when(key % 17 != 0, F.when(key % 19 == 0, "").otherwise(
            F.concat(F.lit("Merchant "), (cust % 120).cast("string"))))
        .alias("merchant_name"),
        F.when(priority == "1-URGENT", "Groceries").when(priority == "2-HIGH", "Dining")
        .when(priority == "3-MEDIUM", "Investments")
        .when(priority == "5-LOW", "Transportation").otherwise("Uncategorized")
        .alias("category"),
        F.when(key % 5 != 0, F.concat(F.lit("Sub "), (cust % 3).cast("string")))
        .alias("subcategory"),
        F.when(key % 7 != 0, (cust + key % 1000).cast("decimal(18,2)")).alias("balance"),
        ((key % 101).cast("double") / 100.0).alias("confidence_score"),
    )


def card_feed(spark, sf_dir, since=None, until=None) -> DataFrame:
    events = _between(table(spark, sf_dir, "events"), "ts", since, until)
    key = F.col("event_id")
    error = F.col("event_type") == "error"
    name = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    raw = F.when(key % 11 != 0, F.concat(F.lit("Shop "), (F.col("user_id") % 40).cast("string")))
    return events.select(
        key.alias("transaction_id"),
        "ts",
        F.col("ts").cast("date").alias("date"),
        name.alias("name"),
        raw.alias("merchant_raw"),
        F.coalesce(raw, name).alias("merchant_name"),
        F.when(error, -F.col("value")).otherwise(F.col("value")).cast("decimal(18,2)")
        .alias("amount"),
        F.col("event_type").alias("category"),
        (key % 5 == 0).alias("pending"),
    )


def feed_ledger(spark, sf_dir, since=None, until=None) -> DataFrame:
    """The feed as a ledger: it is the view with repeated (merchant, amount)."""
    feed = card_feed(spark, sf_dir, since, until)
    return feed.select(
        F.col("transaction_id").alias("id"), "date", "merchant_name",
        F.abs("amount").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("amount") < 0, "CREDIT").otherwise("DEBIT").alias("transaction_type"),
        "category",
    )


def loan(spark, sf_dir, since=None, until=None) -> DataFrame:
    items = _between(table(spark, sf_dir, "lineitem"), "l_shipdate", since, until)
    payment = F.col("l_extendedprice").cast("decimal(18,2)")
    principal = (payment * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,2)")
    return items.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("LOAN# "), (F.col("l_suppkey") % 5).cast("string"))
        .alias("loan_identifier"),
        payment.alias("payment_amount"),
        principal.alias("principal_amount"),
        (payment - principal).cast("decimal(18,2)").alias("interest_amount"),
        (F.col("l_quantity") * 100).cast("decimal(18,2)").alias("balance"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def holdings(spark, sf_dir) -> DataFrame:
    cost = F.col("p_retailprice").cast("decimal(18,2)")
    price = (cost + (F.col("p_partkey") % 201 - 100).cast("decimal(18,2)")).cast("decimal(18,2)")
    return table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("ticker"),
        F.col("p_brand").alias("name"),
        F.col("p_size").cast("decimal(18,2)").alias("quantity"),
        cost.alias("avg_cost"),
        price.alias("current_price"),
    )


def statement_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("stmt_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("filename"),
        F.col("source").alias("bank_name"),
        F.col("text").alias("content"),
    )


def turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.length("text").cast("long").alias("n_chars")
    )


VIEWS = {
    "ledger": """
SELECT o_orderkey AS id, o_orderkey AS raw_id, o_custkey % 40 AS statement_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'capital_one' WHEN 1 THEN 'citi' WHEN 2 THEN 'bofa'
    ELSE 'robinhood' END AS bank_name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'savings' ELSE 'checking' END AS account_type,
  CAST(o_orderdate AS DATE) AS date,
  CASE o_orderkey % 12
    WHEN 0 THEN 'AMZN*MKTP US*2K4F9 SEATTLE WA'
    WHEN 1 THEN 'STARBUCKS STORE ' || CAST(10000 + o_orderkey AS VARCHAR) || ' SEATTLE WA'
    WHEN 2 THEN 'WHOLEFDS #10234 AUSTIN TX' WHEN 3 THEN 'SHELL OIL 57444780203 HOUSTON TX'
    WHEN 4 THEN 'NETFLIX.COM 866-579-7172 CA' WHEN 5 THEN 'PAYROLL DIRECT DEP'
    WHEN 6 THEN 'ACH DEBIT EVERSOURCE ENERGY' WHEN 7 THEN 'TRANSFER FROM CHECKING'
    WHEN 8 THEN 'ROBINHOOD DES:FUNDS' WHEN 9 THEN 'ATM WITHDRAWAL CHASE BANK NYC'
    WHEN 10 THEN 'CIRCUIT CITY 2341 RICHMOND VA' ELSE 'STOP   &   SHOP 12345'
    END AS description,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'DEBIT' WHEN 'O' THEN 'CREDIT' ELSE 'UNKNOWN' END
    AS transaction_type,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ''
    ELSE 'Merchant ' || CAST(o_custkey % 120 AS VARCHAR) END AS merchant_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Groceries' WHEN '2-HIGH' THEN 'Dining'
    WHEN '3-MEDIUM' THEN 'Investments' WHEN '5-LOW' THEN 'Transportation'
    ELSE 'Uncategorized' END AS category,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Sub ' || CAST(o_custkey % 3 AS VARCHAR) END
    AS subcategory,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
    ELSE CAST(o_custkey + o_orderkey % 1000 AS DECIMAL(18,2)) END AS balance,
  CAST(o_orderkey % 101 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS confidence_score
FROM orders""",
    "card_feed": """
SELECT event_id AS transaction_id, ts, CAST(ts AS DATE) AS date,
  'User ' || CAST(user_id AS VARCHAR) AS name,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'Shop ' || CAST(user_id % 40 AS VARCHAR) END
    AS merchant_raw,
  CASE WHEN event_id % 11 = 0 THEN 'User ' || CAST(user_id AS VARCHAR)
    ELSE 'Shop ' || CAST(user_id % 40 AS VARCHAR) END AS merchant_name,
  CAST(CASE WHEN event_type = 'error' THEN -value ELSE value END AS DECIMAL(18,2)) AS amount,
  event_type AS category, event_id % 5 = 0 AS pending
FROM events""",
    "feed_ledger": """
SELECT event_id AS id, CAST(ts AS DATE) AS date,
  CASE WHEN event_id % 11 = 0 THEN 'User ' || CAST(user_id AS VARCHAR)
    ELSE 'Shop ' || CAST(user_id % 40 AS VARCHAR) END AS merchant_name,
  CAST(ABS(value) AS DECIMAL(18,2)) AS amount,
  CASE WHEN CAST(CASE WHEN event_type = 'error' THEN -value ELSE value END AS DECIMAL(18,2)) < 0
    THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
  event_type AS category
FROM events""",
    "loan": """
SELECT CAST(l_shipdate AS DATE) AS date, 'LOAN# ' || CAST(l_suppkey % 5 AS VARCHAR)
    AS loan_identifier,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_amount,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
    AS DECIMAL(18,2)) AS principal_amount,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(CAST(l_extendedprice AS DECIMAL(18,2))
    * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS DECIMAL(18,2))
    AS interest_amount,
  CAST(l_quantity * 100 AS DECIMAL(18,2)) AS balance, l_orderkey, l_linenumber, l_partkey
FROM lineitem""",
    "holdings": """
SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS ticker, p_brand AS name,
  CAST(p_size AS DECIMAL(18,2)) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS avg_cost,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) + CAST(p_partkey % 201 - 100 AS DECIMAL(18,2))
    AS DECIMAL(18,2)) AS current_price
FROM part""",
    "statement_files": """
SELECT doc_id AS file_id, 'stmt_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename,
  source AS bank_name, text AS content FROM documents""",
    "turns": """
SELECT conv_id, turn, role, text, CAST(length(text) AS BIGINT) AS n_chars FROM conversations""",
}
