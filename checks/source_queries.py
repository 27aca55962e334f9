"""Sources and sinks: tables derived from the driver's, written and read back."""

from pyspark.sql import functions as F

from checks import rules_sql as sql
from checks.catalog import add
from checks.feed_queries import AS_DOUBLES, POSITIONS_SQL, as_doubles
from checks.ledger_queries import money_out
from checks.views import card_feed, holdings, ledger, statement_files, turns
from pennywright.functions import fixed_values as fv
from pennywright.sources import csv_statements as csv, feeds, scratch, statement_text


def put(df, fmt, **options):
    """Write `df` to a new shared folder and return the path."""
    path = scratch.shared_folder(df.sparkSession)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.format(fmt).save(path)
    return path


# ------------------------------------------------------------ CSV statements
def csv_path(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    debit = F.col("transaction_type") == "DEBIT"
    shown = F.format_number("amount", 2)
    return put(rows.select(
        F.when(F.col("id") % 10 != 9, F.date_format("date", "MM/dd/yyyy")).alias("Trans Date"),
        F.regexp_replace("description", r"\s+", " ").alias("Memo"),
        F.when(debit, shown).alias("Withdrawal"), F.when(~debit, shown).alias("Deposit"),
        F.col("balance").cast("string").alias("Running Balance"),
        F.col("id").cast("string").alias("Row"),
    ), "csv", header=True)


WHAT = "regexp_replace(description, '\\s+', ' ', 'g')"
KIND = "CASE WHEN transaction_type = 'DEBIT' THEN 'DEBIT' ELSE 'CREDIT' END"

add("s01_csv_columns",
    lambda s, d: csv.rename_fields(csv.read_csv(s, csv_path(s, d)), ["Row"]), f"""
SELECT CAST(id AS VARCHAR) AS "Row", CASE WHEN id % 10 <> 9 THEN strftime(date, '%m/%d/%Y') END
    AS date, {WHAT} AS description, CAST(NULL AS VARCHAR) AS amount,
  CASE WHEN transaction_type = 'DEBIT' THEN format('{{:,.2f}}', CAST(amount AS DOUBLE)) END AS debit,
  CASE WHEN transaction_type <> 'DEBIT' THEN format('{{:,.2f}}', CAST(amount AS DOUBLE)) END
    AS credit, CAST(balance AS VARCHAR) AS balance, CAST(NULL AS VARCHAR) AS type,
  CAST(NULL AS VARCHAR) AS category FROM ledger""", "ledger")

NORMALISED = f"""m AS (SELECT *, {WHAT} AS what, {sql.line_merchant(WHAT)} AS merchant FROM ledger
  WHERE id % 10 <> 9)
SELECT CAST(id AS VARCHAR) AS "Row", date, what AS description, CAST(amount AS DOUBLE) AS amount,
  {KIND} AS transaction_type, merchant AS merchant_name,
  {sql.contains_case("lower(merchant || ' ' || what)", fv.LINE_CATEGORIES, "'Other'")} AS category,
  CAST(balance AS DOUBLE) AS balance, CAST(1.0 AS DOUBLE) AS confidence_score FROM m"""
add("s03_csv_rows",
    lambda s, d: money_out(csv.normalised(csv.read_csv(s, csv_path(s, d)), ["Row"])),
    f"WITH {NORMALISED}", "ledger")


def csv_summaries(spark, sf_dir):
    rows = csv.normalised(csv.read_csv(spark, csv_path(spark, sf_dir)), ["Row"])
    return csv.parse_summary(rows.withColumn("bucket", F.col("Row").cast("long") % 50), ["bucket"])


add("a20_parse_summary", csv_summaries, """
SELECT id % 50 AS bucket, COUNT(*) AS total_transactions,
  CAST(SUM(CASE WHEN transaction_type = 'DEBIT' THEN amount ELSE 0 END) AS DOUBLE) AS total_debits,
  CAST(SUM(CASE WHEN transaction_type <> 'DEBIT' THEN amount ELSE 0 END) AS DOUBLE) AS total_credits,
  CAST(SUM(CASE WHEN transaction_type = 'DEBIT' THEN -amount ELSE amount END) AS DOUBLE) AS net
FROM ledger WHERE id % 10 <> 9 GROUP BY 1""", "ledger")


def two_encodings(spark, sf_dir):
    """Half of the rows in UTF-8 files, half in Latin-1 files."""
    rows = ledger(spark, sf_dir).select(
        F.col("id").cast("string").alias("Row"), F.date_format("date", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit("CAFÉ "), F.col("id") % 12).alias("Memo"),
        F.col("amount").cast("string").alias("Amount"))
    even = F.col("Row").cast("long") % 2 == 0
    base = scratch.shared_folder(spark)
    rows.filter(even).write.option("header", True).csv(f"{base}/a")
    rows.filter(~even).write.option("header", True).option("encoding", "ISO-8859-1").csv(
        f"{base}/b")
    read = csv.read_any_encoding(spark, f"{base}/*/*.csv", "Row,Date,Memo,Amount")
    return money_out(csv.normalised(read, ["Row"]).select("Row", "date", "description", "amount"))


add("s02_csv_encodings", two_encodings, """
SELECT CAST(id AS VARCHAR) AS "Row", date, 'CAFÉ ' || CAST(id % 12 AS VARCHAR) AS description,
  CAST(amount AS DOUBLE) AS amount FROM ledger""", "ledger")


def exported(spark, sf_dir):
    """Dates as text in three spellings go out, come back typed."""
    k = F.col("id") % 3
    shown = (F.when(k == 0, F.date_format("date", "MM/dd/yyyy"))
             .when(k == 1, F.date_format("date", "yyyyMMdd"))
             .otherwise(F.date_format("date", "yyyy-MM-dd")))
    rows = ledger(spark, sf_dir).select(
        "id", "statement_id", shown.alias("date"), "merchant_name", "amount", "balance",
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 03uman:27:58"))
        .alias("enriched_at"))
    path = scratch.shared_folder(spark)
    csv.export_csv(rows, path)
    return path


EXPORTED = """SELECT CAST(id AS VARCHAR) AS id, CAST(statement_id AS VARCHAR) AS statement_id,
  strftime(date, '%Y-%m-%d') AS date, NULLIF(merchant_name, '') AS merchant_name,
  CAST(amount AS VARCHAR) AS amount, CAST(balance AS VARCHAR) AS balance,
  strftime(date, '%Y-%m-%d') || ' 03uman:27:58' AS enriched_at FROM ledger"""
add("s14_csv_export", lambda s, d: s.read.option("header", True).csv(exported(s, d)), EXPORTED,
    "ledger")
add("s16_typed_import",
    lambda s, d: csv.import_csv(s, exported(s, d)).withColumn(
        "enriched_at", F.col("enriched_at").cast("timestamp_ntz")), """
SELECT id, statement_id, date, NULLIF(merchant_name, '') AS merchant_name,
  CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
  CAST(date AS TIMESTAMP) + INTERVAL '3 hours 27 minutes 58 seconds' AS enriched_at
FROM ledger""", "ledger")


def coerced(spark, sf_dir):
    from pennywright.operators.tables import coerce
    odd = F.col("id") % 7 == 3
    rows = ledger(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"),
        F.when(odd, "x").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(odd, "").otherwise(F.col("statement_id").cast("string")).alias("statement_id"),
        "description")
    return coerce(rows)


add("s17_coerce_columns", coerced, """
SELECT id, CASE WHEN id % 7 <> 3 THEN CAST(amount AS DOUBLE) END AS amount,
  CASE WHEN id % 7 <> 3 THEN statement_id END AS statement_id, description FROM ledger""",
    "ledger")


# ------------------------------------------------------------ JSON
def json_arrays(spark, sf_dir):
    """A JSON array per line, two rows in each."""
    rows = ledger(spark, sf_dir).select(F.to_json(F.array(*[F.struct(
        F.concat(F.lit(mark), "id").alias("id"), F.col("description").alias("raw_description"),
        (F.lit(sign) * F.col("amount")).cast("double").alias("amount"),
        F.date_format("date", "yyyy-MM-dd").alias("date")) for mark, sign in (("t", -1), ("u", 1))]
    )).alias("value"))
    return feeds.read_transactions(spark, put(rows, "text"), whole_files=False)


add("s06_json_arrays", json_arrays, """
SELECT 't' || CAST(id AS VARCHAR) AS id, description AS raw_description,
  -CAST(amount AS DOUBLE) AS amount, strftime(date, '%Y-%m-%d') AS date FROM ledger UNION ALL
SELECT 'u' || CAST(id AS VARCHAR), description, CAST(amount AS DOUBLE),
  strftime(date, '%Y-%m-%d') FROM ledger""", "ledger")


def feed_pages(spark, sf_dir):
    """Feed pages: one transaction list per page and day-block, nested category."""
    rows = card_feed(spark, sf_dir)
    k = F.col("transaction_id") % 3
    nested = F.struct(
        F.concat(F.lit("x"), "transaction_id").alias("transaction_id"),
        F.date_format("date", "yyyy-MM-dd").alias("date"), "name",
        F.col("merchant_raw").alias("merchant_name"), F.col("amount").cast("double").alias("amount"),
        F.when(k == 0, F.struct(F.col("category").alias("primary")))
        .alias("personal_finance_category"),
        F.when(k == 1, F.array(F.upper("category"), F.lit("second"))).alias("category"),
        F.when(F.col("transaction_id") % 4 != 0, F.col("pending")).alias("pending"))
    return rows.select(
        F.lit(1).cast("long").alias("total_transactions"),
        F.array(nested).alias("transactions"))


FEED_SQL = """
SELECT 'x' || CAST(transaction_id AS VARCHAR) AS transaction_id, date, name,
  COALESCE(merchant_raw, name) AS merchant_name, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN amount < 0 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
  CASE transaction_id % 3 WHEN 0 THEN category WHEN 1 THEN upper(category)
    ELSE 'Uncategorized' END AS category,
  CASE WHEN transaction_id % 4 <> 0 THEN pending ELSE false END AS pending FROM card_feed"""
add("s11_feed_scan",
    lambda s, d: money_out(feeds.read_feed(s, put(feed_pages(s, d), "json"))), FEED_SQL,
    "card_feed")


def pages_together(spark, sf_dir):
    """Two page folders read as one feed."""
    pages = feed_pages(spark, sf_dir)
    first = F.col("transactions")[0]["transaction_id"].endswith("1")
    base = scratch.shared_folder(spark)
    pages.filter(first).write.json(f"{base}/page=1")
    pages.filter(~first).write.json(f"{base}/page=2")
    return money_out(feeds.read_feed(spark, [f"{base}/page=1", f"{base}/page=2"]))


add("x02_feed_pages", pages_together, FEED_SQL, "card_feed")


# ------------------------------------------------------------ holdings
def broker_csv(spark, sf_dir):
    held = holdings(spark, sf_dir)
    skip = F.col("ticker").endswith("3")
    path = put(held.select(
        F.when(F.col("ticker").endswith("9"), "").otherwise(F.col("ticker")).alias("Symbol"),
        F.col("name").alias("Name"),
        F.when(skip, "0").otherwise(F.col("quantity").cast("string")).alias("Quantity"),
        F.col("avg_cost").alias("Average Cost")), "csv", header=True)
    prices = held.filter(~F.col("ticker").endswith("5")).select(
        "ticker", F.col("current_price").alias("price"))
    return as_doubles(feeds.read_holdings_csv(spark, path, prices))


HELD = """kept AS (SELECT * REPLACE (CASE WHEN ticker LIKE '%5' THEN avg_cost ELSE current_price END
  AS current_price) FROM holdings WHERE ticker NOT LIKE '%3' AND ticker NOT LIKE '%9')"""
HELD_SQL = (f"WITH {HELD}, {POSITIONS_SQL.replace('FROM holdings', 'FROM kept')} "
            f"SELECT ticker, name, {AS_DOUBLES} FROM positions")
add("s12_holdings_csv", broker_csv, HELD_SQL, "holdings")


def broker_json(spark, sf_dir):
    """Symbols as text, as an object, and as an object in an object."""
    held = holdings(spark, sf_dir)
    last = F.substring("ticker", -1, 1)
    flat = F.to_json(F.struct(F.col("ticker").alias("symbol"), F.col("name").alias("description")))
    symbol = (
        F.when(last.isin("0", "1"), F.concat(F.lit('{"symbol":'), flat, F.lit("}")))
        .when(last.isin("2", "4", "5", "6"), flat)
        .otherwise(F.concat(F.lit('"'), "ticker", F.lit('"')))
    )
    units = F.when(last.isin("3", "9"), F.lit("0")).otherwise(F.col("quantity").cast("string"))
    price = F.when(last == "5", F.lit("0")).otherwise(F.col("current_price").cast("string"))
    value = F.concat(
        F.lit('{"symbol":'), symbol, F.lit(',"units":'), units,
        F.lit(',"average_purchase_price":'), F.col("avg_cost").cast("string"),
        F.lit(',"price":'), price, F.lit("}"))
    path = put(held.select(value.alias("value")), "text")
    prices = held.select("ticker", F.col("avg_cost").alias("price"))
    return as_doubles(feeds.read_positions_json(spark, path, prices))


add("s13_positions_json", broker_json, f"""
WITH {HELD}, {POSITIONS_SQL.replace('FROM holdings', 'FROM kept')}
SELECT ticker, CASE WHEN right(ticker, 1) IN ('7', '8') THEN ticker ELSE name END AS name,
  {AS_DOUBLES} FROM positions""", "holdings")


# ------------------------------------------------------------ turn logs
def turn_log(spark, sf_dir):
    log = turns(spark, sf_dir).select(
        F.col("turn").alias("turn_number"), F.col("text").alias("question"),
        F.array(F.lit("get_categories"), "role").alias("tools_invoked"),
        F.array(F.create_map(F.lit("conv"), F.col("conv_id").cast("string")))
        .alias("tool_results"),
        F.col("role").alias("final_answer"), F.col("n_chars").alias("input_tokens"),
        F.lit(1).cast("long").alias("output_tokens"), F.lit(0.25).alias("cost_usd"),
        F.lit("2024-01-31T00:00:00").alias("timestamp"))
    path = scratch.shared_folder(spark)
    feeds.write_turn_log(log, path)
    back = feeds.read_turn_log(spark, path)
    return back.select(
        "turn_number", "question", F.array_join("tools_invoked", ",").alias("tools"),
        F.get("tool_results", F.lit(0))["conv"].alias("conv"), "final_answer", "input_tokens",
        "output_tokens", "cost_usd", "timestamp")


add("s27_turn_log", turn_log, """
SELECT turn AS turn_number, text AS question, 'get_categories,' || role AS tools,
  CAST(conv_id AS VARCHAR) AS conv, role AS final_answer, n_chars AS input_tokens,
  CAST(1 AS BIGINT) AS output_tokens, CAST(0.25 AS DOUBLE) AS cost_usd,
  '2024-01-31T00:00:00' AS timestamp FROM turns""", "turns")


# ------------------------------------------------------------ text files
FOLDERS = 64


def folder_of_texts(spark, sf_dir):
    """Documents written as text files in a fixed number of folders."""
    path = scratch.shared_folder(spark)
    statement_files(spark, sf_dir).select(
        F.replace(F.col("content"), F.lit("\n"), F.lit("\x0b")).alias("value"),
        (F.col("file_id") % FOLDERS).alias("folder")).write.partitionBy("folder").text(path)
    return path


def scanned(spark, sf_dir):
    files = statement_text.read_text(spark, f"{folder_of_texts(spark, sf_dir)}/*/*.txt")
    hashed = F.sha2(F.col("content").cast("binary"), 256)
    return files.groupBy(
        F.regexp_extract("original_path", r"folder=(\d+)", 1).cast("long").alias("folder")
    ).agg(F.sum(F.length("content")).alias("n_chars"),
          F.bool_and(F.col("file_hash") == hashed).alias("same_hash"))


add("s07_folder_scan", scanned, f"""
SELECT file_id % {FOLDERS} AS folder, CAST(SUM(length(content) + 1) AS BIGINT) AS n_chars,
  true AS same_hash FROM statement_files GROUP BY 1""", "statement_files")
