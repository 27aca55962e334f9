"""Landed JSON and CSV: card feed, holdings, transactions, turn logs."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pennywright.functions.money import MONEY, feed_type, position_values
from pennywright.sources.csv_statements import read_csv

#: Quantities and prices keep their fractions; only results are rounded to cents.
SHARES = "decimal(18,8)"

FEED_PAGE = """total_transactions long, transactions array<struct<
transaction_id: string, date: string, name: string, merchant_name: string, amount: double,
personal_finance_category: struct<primary: string>, category: array<string>,
pending: boolean>>"""
TRANSACTIONS = "id string, raw_description string, amount double, date string"
TURN_LOG = """turn_number long, question string, tools_invoked array<string>,
tool_results array<map<string,string>>, final_answer string, input_tokens long,
output_tokens long, cost_usd double, timestamp string"""


def read_feed(spark: SparkSession, path) -> DataFrame:
    """All pages of a card feed (one JSON page per line), as flat rows."""
    pages = spark.read.schema(FEED_PAGE).json(path)
    return flatten_feed(pages.select(F.explode("transactions").alias("t")).select("t.*"))


def flatten_feed(rows: DataFrame) -> DataFrame:
    amount = F.col("amount").cast(MONEY)

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return rows.select(
        "transaction_id",
        F.col("date").cast("date").alias("date"),
        "name",
        F.coalesce(given(F.col("merchant_name")), "name").alias("merchant_name"),
        amount.alias("amount"),
        feed_type(amount).alias("transaction_type"),
        F.coalesce(
            given(F.col("personal_finance_category.primary")),
            F.get("category", F.lit(0)), F.lit("Uncategorized"),
        ).alias("category"),
        F.coalesce("pending", F.lit(False)).alias("pending"),
    )


def read_transactions(spark: SparkSession, path, whole_files: bool = True) -> DataFrame:
    """JSON arrays of transactions, one per file or (splittable) one per line."""
    return spark.read.schema(TRANSACTIONS).option("multiLine", whole_files).json(path)


def read_turn_log(spark: SparkSession, path, whole_files: bool = False) -> DataFrame:
    """Turn records, one per line, or with `whole_files` one (indented) record per file."""
    return spark.read.schema(TURN_LOG).option("multiLine", whole_files).json(path)


def write_turn_log(turns: DataFrame, path: str) -> None:
    """Turn records as JSON lines, partitioned by nothing: Spark sizes the files."""
    turns.write.json(path)


def _either(df: DataFrame, *names: str) -> Column:
    """First non-empty value of columns that may or may not be there."""
    present = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def read_holdings_csv(spark: SparkSession, path, prices: DataFrame = None) -> DataFrame:
    """Broker CSV in either header spelling; rows without ticker or quantity go.

    A missing price is the average cost.  `prices` has ticker and price.
    """
    df = read_csv(spark, path)
    ticker = _either(df, "Symbol", "symbol")
    rows = df.select(
        ticker.alias("ticker"),
        F.coalesce(_either(df, "Name", "name"), ticker).alias("name"),
        F.coalesce(_either(df, "Quantity", "quantity").try_cast(SHARES), F.lit(0)).cast(SHARES)
        .alias("quantity"),
        F.coalesce(_either(df, "Average Cost", "average_buy_price").try_cast(SHARES), F.lit(0))
        .cast(SHARES).alias("avg_cost"),
    ).filter(F.col("ticker").isNotNull() & (F.col("quantity") != 0))
    return priced(rows, prices)


def priced(rows: DataFrame, prices: DataFrame | None) -> DataFrame:
    """Add current_price, equity and pct_change."""
    price = F.col("avg_cost")
    if prices is not None:
        rows = rows.join(prices.select("ticker", "price"), "ticker", "left")
        price = F.coalesce(F.nullif(F.col("price"), F.lit(0)), "avg_cost")
    valued = rows.withColumn("current_price", price.cast(SHARES))
    return valued.withColumns(
        position_values(F.col("quantity"), F.col("avg_cost"), F.col("current_price"))
    ).select("ticker", "name", "quantity", "avg_cost", "current_price", "equity", "pct_change")


def read_positions_json(spark: SparkSession, path, prices: DataFrame = None) -> DataFrame:
    """Nested broker positions, one JSON object per line.

    The symbol may be text, an object, or an object inside an object; positions
    without units are skipped and a zero price is looked up.
    """
    raw = spark.read.text(path)

    def at(*paths):
        found = [F.nullif(F.get_json_object("value", p), F.lit("")) for p in paths]
        return F.coalesce(*found)

    def plain(c):
        """Text that is not itself a JSON object."""
        return F.when(~c.startswith("{"), F.trim(c))

    ticker = F.coalesce(
        plain(at("$.symbol.symbol.symbol")), plain(at("$.symbol.symbol.raw_symbol")),
        plain(at("$.symbol.symbol")), plain(at("$.symbol.raw_symbol")),
        plain(at("$.symbol.ticker")), plain(at("$.symbol")), F.lit("???"),
    )
    name = F.coalesce(
        at("$.symbol.symbol.description", "$.symbol.symbol.name", "$.symbol.description",
           "$.symbol.name"), ticker)

    def number(path):
        return F.coalesce(F.get_json_object("value", path).try_cast(SHARES), F.lit(0)).cast(SHARES)

    rows = raw.select(
        ticker.alias("ticker"), name.alias("name"), number("$.units").alias("quantity"),
        number("$.average_purchase_price").alias("avg_cost"), number("$.price").alias("_price"),
    ).filter(F.col("quantity") != 0)
    if prices is not None:
        rows = rows.join(prices.select("ticker", "price"), "ticker", "left").withColumn(
            "_price", F.coalesce(F.nullif(F.col("_price"), F.lit(0)), "price", F.lit(0)))
    valued = rows.withColumn("current_price", F.col("_price").cast(SHARES))
    return valued.withColumns(
        position_values(F.col("quantity"), F.col("avg_cost"), F.col("current_price"))
    ).select("ticker", "name", "quantity", "avg_cost", "current_price", "equity", "pct_change")
