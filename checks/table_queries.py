"""Registries, upserts, deletes, pairing and rules over the driver's tables."""

from pyspark.sql import functions as F

from checks.catalog import add
from checks.ledger_queries import ROW, money_out
from checks.views import card_feed, ledger, loan, statement_files, table
from pennywright.operators import enrich, joins, pairing, tables, validate
from pennywright.operators.keyed_table import KeyedTable
from pennywright.plans import bank, card, ingest
from pennywright.sources import scratch


# ------------------------------------------------------------ file registry
def hashed_files(spark, sf_dir):
    return statement_files(spark, sf_dir).select(
        F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"),
        F.col("filename").alias("original_path"), "filename", "bank_name", "file_id")


def registry(spark, sf_dir):
    """What an earlier run imported: the files of source src0, ids from 101 on."""
    old = hashed_files(spark, sf_dir).filter("bank_name = 'src0'")
    return tables.new_statements(
        spark.createDataFrame([], "id long, file_hash string"), old
    ).withColumn("id", F.col("id") + 100)


HASHED = """hashed AS (SELECT sha256(content) AS file_hash, filename AS original_path, filename,
  bank_name, file_id FROM statement_files),
registry AS (SELECT 100 + row_number() OVER (ORDER BY file_hash) AS id, file_hash FROM
  (SELECT DISTINCT file_hash FROM hashed WHERE bank_name = 'src0'))"""

add("s09_duplicate_files",
    lambda s, d: tables.file_outcomes(registry(s, d), hashed_files(s, d)).select(
        "original_path", "file_hash", "outcome"), f"""
WITH {HASHED}, firsts AS (SELECT file_hash, MIN(original_path) AS first FROM hashed GROUP BY 1)
SELECT h.original_path, h.file_hash, CASE WHEN r.id IS NOT NULL THEN 'imported before'
  WHEN h.original_path = f.first THEN 'new' ELSE 'duplicate' END AS outcome
FROM hashed h JOIN firsts f USING (file_hash) LEFT JOIN registry r USING (file_hash)""",
    "statement_files")

add("a37_outcome_counts",
    lambda s, d: tables.outcome_counts(tables.file_outcomes(registry(s, d), hashed_files(s, d))),
    f"""
WITH {HASHED}, firsts AS (SELECT file_hash, MIN(original_path) AS first FROM hashed GROUP BY 1)
SELECT CASE WHEN r.id IS NOT NULL THEN 'imported before' WHEN h.original_path = f.first THEN 'new'
  ELSE 'duplicate' END AS outcome, COUNT(*) AS files
FROM hashed h JOIN firsts f USING (file_hash) LEFT JOIN registry r USING (file_hash)
GROUP BY 1""", "statement_files")

NEW_FILES = f"""
WITH {HASHED}, fresh AS (SELECT file_hash, MIN(original_path) AS original_path FROM hashed
  WHERE file_hash NOT IN (SELECT file_hash FROM registry) GROUP BY 1)
SELECT (SELECT MAX(id) FROM registry) + row_number() OVER (ORDER BY file_hash) AS id, file_hash,
  original_path FROM fresh"""


def new_files(spark, sf_dir):
    return tables.new_statements(registry(spark, sf_dir), hashed_files(spark, sf_dir)).select(
        "id", "file_hash", "original_path")


add("s22_new_statements", new_files, NEW_FILES, "statement_files")


def continued_ids(spark, sf_dir):
    """Ids carry on after the highest one, without gaps."""
    old = registry(spark, sf_dir)
    both = old.select("id").unionByName(new_files(spark, sf_dir).select("id"))
    return both.agg(F.min("id").alias("first"), F.max("id").alias("last"),
                    F.count("id").alias("n"), F.countDistinct("id").alias("n_distinct"))


add("s23_id_continuation", continued_ids, f"""
WITH {HASHED} SELECT CAST(101 AS BIGINT) AS first, 100 + COUNT(DISTINCT file_hash) AS last,
  COUNT(DISTINCT file_hash) AS n, COUNT(DISTINCT file_hash) AS n_distinct FROM hashed""",
    "statement_files")


def registry_ids(spark, sf_dir):
    """The registry against a second store that only knows every other hash."""
    other = registry(spark, sf_dir).filter("id % 2 = 0").withColumn("id", F.col("id") * 10)
    return joins.registry_map(registry(spark, sf_dir), other)


add("j01_registry_map", registry_ids, f"""
WITH {HASHED} SELECT id AS left_id, file_hash, CASE WHEN id % 2 = 0 THEN id * 10 END AS right_id
FROM registry""", "statement_files")


# ------------------------------------------------------------ pairing
def pairs(spark, sf_dir):
    """Ledger rows whose keys repeat (day and description cut down), two stores."""
    rows = ledger(spark, sf_dir).select(
        "id", "statement_id", F.trunc("date", "YEAR").alias("date"),
        F.when(F.col("id") % 13 != 0, F.substring("description", 1, 3)).alias("description"),
        (F.col("id") % 5).cast("decimal(18,2)").alias("amount"))
    right = rows.filter("id % 7 <> 0").withColumn("statement_id", F.col("statement_id") + 1000)
    right = right.withColumn("id", F.col("id") + 1_000_000)
    statements = rows.select(F.col("statement_id").alias("left_id")).distinct().select(
        "left_id", F.when(F.col("left_id") % 10 != 3, F.col("left_id") + 1000).alias("right_id"))
    return pairing.pair_in_order(rows, right, statements)


add("j02_pair_in_order", pairs, """
WITH rows AS (SELECT id, statement_id, date_trunc('year', date) AS date,
    CASE WHEN id % 13 <> 0 THEN description[1:3] END AS description, id % 5 AS amount FROM ledger),
l AS (SELECT id, statement_id, date, description, amount, row_number() OVER
    (PARTITION BY statement_id, date, description, amount ORDER BY id) AS n FROM rows
  WHERE statement_id % 10 <> 3),
r AS (SELECT id + 1000000 AS id, statement_id, date, description, amount, row_number() OVER
    (PARTITION BY statement_id, date, description, amount ORDER BY id) AS n FROM rows
  WHERE id % 7 <> 0)
SELECT l.id AS left_id, r.id AS right_id FROM l LEFT JOIN r ON l.statement_id = r.statement_id
  AND l.date = r.date AND l.description IS NOT DISTINCT FROM r.description
  AND l.amount = r.amount AND l.n = r.n""", "ledger")


# ------------------------------------------------------------ enrichment runs
def enriched_before(spark, sf_dir):
    return ledger(spark, sf_dir).filter("id % 3 = 0").select("raw_id", "confidence_score")


def some_without_id(spark, sf_dir):
    """The ledger, every eleventh row that is not yet enriched without its id."""
    done = (F.col("id") % 3 == 0) & (F.col("confidence_score") >= 0.5)
    return ledger(spark, sf_dir).withColumn(
        "id", F.when((F.col("id") % 11 != 5) | done, F.col("id")))


add("j03_not_yet_enriched",
    lambda s, d: joins.not_yet_enriched(ledger(s, d), enriched_before(s, d), 0.5).select("id"),
    "SELECT id FROM ledger WHERE NOT (id % 3 = 0 AND confidence_score >= 0.5)", "ledger")

add("a24_run_stats",
    lambda s, d: enrich.run_stats(some_without_id(s, d), enriched_before(s, d), 0.5), """
SELECT COUNT(*) AS total_raw,
  COUNT(CASE WHEN id % 11 <> 5 AND NOT (id % 3 = 0 AND confidence_score >= 0.5) THEN 1 END)
    AS processed,
  COUNT(CASE WHEN id % 3 = 0 AND confidence_score >= 0.5 THEN 1 END) AS skipped,
  COUNT(CASE WHEN id % 11 = 5 AND NOT (id % 3 = 0 AND confidence_score >= 0.5) THEN 1 END)
    AS errors FROM ledger""", "ledger")

add("p19_enrichment_input",
    lambda s, d: enrich.chosen_input(ledger(s, d), 7, "savings").select("id", "description"),
    "SELECT id, description FROM ledger WHERE statement_id = 7 AND account_type = 'savings'",
    "ledger")


# ------------------------------------------------------------ statements and rows
def statements(spark, sf_dir):
    """Customers as statements; some have no rows, some rows no statement."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"),
        F.col("c_mktsegment").alias("bank_name"),
        F.lit("2001-08-01").cast("date").alias("statement_date"),
        (F.col("c_custkey") * 7 % 1000).alias("import_date"))


def rows(spark, sf_dir):
    return ledger(spark, sf_dir).withColumn("statement_id", F.col("raw_id") % 1700)


STATEMENTS = """statements AS (SELECT c_custkey AS id, c_name AS filename,
  c_mktsegment AS bank_name, DATE '2001-08-01' AS statement_date,
  c_custkey * 7 % 1000 AS import_date FROM customer),
rows AS (SELECT * REPLACE (raw_id % 1700 AS statement_id) FROM ledger)"""
TOTALS = f"""
SELECT s.*, COALESCE(t.n, 0) AS total_transactions, COALESCE(t.d, 0) AS total_debits,
  COALESCE(t.c, 0) AS total_credits FROM statements s LEFT JOIN (
  SELECT statement_id, COUNT(*) AS n,
    CAST(SUM(CASE WHEN transaction_type = 'DEBIT' THEN amount END) AS DOUBLE) AS d,
    CAST(SUM(CASE WHEN transaction_type = 'CREDIT' THEN amount END) AS DOUBLE) AS c
  FROM rows GROUP BY statement_id) t ON t.statement_id = s.id"""


def totals(spark, sf_dir):
    return money_out(tables.statement_totals(statements(spark, sf_dir), rows(spark, sf_dir)),
                     "total_debits", "total_credits")


add("a17_statement_totals", totals, f"WITH {STATEMENTS} {TOTALS}", "ledger")
add("p10_card_statements", lambda s, d: card.statements(totals(s, d)),
    f"WITH {STATEMENTS} {TOTALS}", "ledger")
add("p10_bank_statements",
    lambda s, d: bank.statements(totals(s, d).withColumns({
        "statement_period_start": F.add_months("statement_date", -1),
        "statement_period_end": F.date_add("statement_date", -1)})),
    f"""WITH {STATEMENTS}, t AS ({TOTALS})
SELECT id, filename, bank_name, DATE '2001-07-01' AS statement_period_start,
  DATE '2001-07-31' AS statement_period_end, import_date, total_transactions, total_debits,
  total_credits FROM t""", "ledger")


add("j05_rows_with_statement",
    lambda s, d: tables.rows_per_bank(statements(s, d), rows(s, d)), f"""
WITH {STATEMENTS} SELECT s.bank_name, COUNT(*) AS n_rows,
  COUNT(DISTINCT s.id) AS n_statements, CAST(SUM(r.amount) AS DOUBLE) AS amount
FROM rows r JOIN statements s ON s.id = r.statement_id GROUP BY s.bank_name""", "ledger")

ORPHANS = f"""
WITH {STATEMENTS} SELECT id, statement_id FROM rows
WHERE statement_id NOT IN (SELECT id FROM statements)"""
add("j11_orphan_rows",
    lambda s, d: joins.orphans(rows(s, d), statements(s, d), "statement_id", "id").select(
        "id", "statement_id"), ORPHANS, "ledger")
add("v03_missing_parents",
    lambda s, d: validate.missing_parents(rows(s, d), statements(s, d), "statement_id").select(
        "id", "statement_id"), ORPHANS, "ledger")


def after_delete(spark, sf_dir):
    enriched = rows(spark, sf_dir).select(F.col("id").alias("raw_id"), "category")
    kept = tables.delete_bank("BUILDING", statements(spark, sf_dir), rows(spark, sf_dir), enriched)
    return tables.table_counts(dict(zip(("statements", "raw", "enriched"), kept)))


GONE = f"""WITH {STATEMENTS}, gone AS (SELECT id FROM statements WHERE bank_name = 'BUILDING')"""
add("s24_delete_bank", after_delete, f"""
{GONE} SELECT 'statements' AS table_name, COUNT(*) AS row_count FROM statements
  WHERE bank_name <> 'BUILDING'
UNION ALL SELECT t, n FROM (SELECT unnest(['raw', 'enriched']) AS t, (SELECT COUNT(*) FROM rows
  WHERE statement_id NOT IN (SELECT id FROM gone)) AS n)""", "ledger")


def delete_preview(spark, sf_dir):
    enriched = rows(spark, sf_dir).filter("id % 2 = 0").select(F.col("id").alias("raw_id"))
    return tables.delete_preview("BUILDING", statements(spark, sf_dir), rows(spark, sf_dir),
                                 enriched)


add("j12_delete_preview", delete_preview, f"""
{GONE} SELECT 'statements' AS table_name, COUNT(*) AS row_count FROM gone
UNION ALL SELECT 'raw', COUNT(*) FROM rows WHERE statement_id IN (SELECT id FROM gone)
UNION ALL SELECT 'enriched', COUNT(*) FROM rows WHERE id % 2 = 0
  AND statement_id IN (SELECT id FROM gone)""", "ledger")


def table_counts(spark, sf_dir):
    return tables.table_counts({
        "ledger": ledger(spark, sf_dir), "loan": loan(spark, sf_dir),
        "feed": card_feed(spark, sf_dir), "emptied": tables.emptied(ledger(spark, sf_dir)),
        "absent": None})


add("a23_table_counts", table_counts, """
SELECT 'ledger' AS table_name, COUNT(*) AS row_count FROM orders UNION ALL
SELECT 'loan', COUNT(*) FROM lineitem UNION ALL SELECT 'feed', COUNT(*) FROM events UNION ALL
SELECT 'emptied', 0 UNION ALL SELECT 'absent', -1""")


def emptied(spark, sf_dir):
    """Counts before clearing, and what is left after it."""
    full = ledger(spark, sf_dir)
    return tables.table_counts({"before": full, "after": tables.emptied(full)})


add("s25_clear_table", emptied, """
SELECT 'before' AS table_name, COUNT(*) AS row_count FROM orders UNION ALL SELECT 'after', 0""")


add("a21_ingest_report",
    lambda s, d: ingest.report(statements(s, d), rows(s, d)), f"""
WITH {STATEMENTS} SELECT 'account' AS section, account_type AS name, COUNT(*) AS n,
  CAST(SUM(amount) AS DOUBLE) AS total, MIN(date) AS earliest, MAX(date) AS latest
FROM rows GROUP BY account_type
UNION ALL SELECT 'bank', bank_name, COUNT(*), NULL, NULL, NULL FROM statements
GROUP BY bank_name""", "ledger")

add("a36_taxonomy_size",
    lambda s, d: enrich.taxonomy_size(ledger(s, d)), """
SELECT category, COUNT(DISTINCT subcategory) AS n_subcategories,
  COUNT(DISTINCT merchant_name) AS n_merchants FROM ledger GROUP BY category""", "ledger")


# ------------------------------------------------------------ upserts
def old_rows(spark, sf_dir):
    return ledger(spark, sf_dir).filter("id % 3 <> 2").select(
        "raw_id", "date", "description", "amount", "category", "merchant_name",
        "confidence_score")


def new_rows(spark, sf_dir):
    return ledger(spark, sf_dir).filter("id % 2 = 0").select(
        "raw_id", "date", F.lit("re-read").alias("description"),
        (F.col("amount") + 1).cast("decimal(18,2)").alias("amount"),
        F.lit("Reviewed").alias("category"),
        F.when(F.col("id") % 4 == 0, F.col("merchant_name")).alias("merchant_name"),
        F.lit(0.9).alias("confidence_score"))


OLD_NEW = """old AS (SELECT raw_id, date, description, amount, category, merchant_name,
  confidence_score FROM ledger WHERE id % 3 <> 2),
new AS (SELECT raw_id, date, 're-read' AS description, amount + 1 AS amount,
  'Reviewed' AS category, CASE WHEN id % 4 = 0 THEN merchant_name END AS merchant_name,
  CAST(0.9 AS DOUBLE) AS confidence_score FROM ledger WHERE id % 2 = 0)"""

add("s18_upsert_enrichment",
    lambda s, d: money_out(tables.upsert_enrichment(old_rows(s, d), new_rows(s, d))), f"""
WITH {OLD_NEW} SELECT raw_id, COALESCE(o.date, n.date) AS date,
  COALESCE(o.description, n.description) AS description,
  CAST(COALESCE(o.amount, n.amount) AS DOUBLE) AS amount,
  COALESCE(n.category, o.category) AS category,
  CASE WHEN n.category IS NOT NULL THEN n.merchant_name ELSE o.merchant_name END AS merchant_name,
  COALESCE(n.confidence_score, o.confidence_score) AS confidence_score
FROM old o FULL JOIN new n USING (raw_id)""", "ledger")

add("s19_upsert_rows",
    lambda s, d: money_out(tables.upsert_rows(old_rows(s, d), new_rows(s, d))), f"""
WITH {OLD_NEW} SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM (
  SELECT * FROM old WHERE raw_id NOT IN (SELECT raw_id FROM new) UNION ALL SELECT * FROM new)""",
    "ledger")


def replaced(spark, sf_dir):
    new = new_rows(spark, sf_dir).drop("confidence_score", "merchant_name")
    return money_out(tables.insert_or_replace(
        old_rows(spark, sf_dir), new, ["raw_id"], {"confidence_score": 0.0}))


add("s20_insert_or_replace", replaced, f"""
WITH {OLD_NEW} SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM (
  SELECT * FROM old WHERE raw_id NOT IN (SELECT raw_id FROM new) UNION ALL
  SELECT * REPLACE (NULL AS merchant_name, CAST(0 AS DOUBLE) AS confidence_score) FROM new)""",
    "ledger")


def keyed(spark, rows, key, unique=()):
    """A bucketed table of the rows in a new folder; about 200,000 rows a bucket."""
    made = KeyedTable(spark, f"{scratch.shared_folder(spark)}/keyed", key, unique,
                      buckets=max(8, rows.count() // 200_000))
    made.create(rows)
    return made


def bucket_upsert(spark, sf_dir):
    """The rows of s18, through a bucketed table and in two batches."""
    held = keyed(spark, old_rows(spark, sf_dir), "raw_id")
    for rest in (0, 2):
        held.upsert(new_rows(spark, sf_dir).filter(F.col("raw_id") % 4 == rest),
                    tables.upsert_enrichment)
    return money_out(held.read())


def bucket_replace(spark, sf_dir):
    held = keyed(spark, old_rows(spark, sf_dir), "raw_id")
    held.upsert(new_rows(spark, sf_dir), tables.upsert_rows)
    return money_out(held.read())


#: Rows known by their id and by a reference; the new ones carry the reference of the next row on.
def referenced(spark, sf_dir):
    return ledger(spark, sf_dir).select("raw_id", F.concat(F.lit("r"), "raw_id").alias("reference"),
                                        "amount", "category")


def bucket_insert_or_replace(spark, sf_dir):
    old = referenced(spark, sf_dir).filter("raw_id % 3 <> 2")
    held = keyed(spark, old, "raw_id", ["reference"])
    new = referenced(spark, sf_dir).filter("raw_id % 5 = 0").select(
        "raw_id", F.concat(F.lit("r"), F.col("raw_id") + 1).alias("reference"), "amount")
    held.insert_or_replace(new, {"category": "none"})
    return money_out(held.read())


def marked_delete(spark, sf_dir):
    """Deleted keys, some of which come back; then all of it compacted."""
    held = keyed(spark, old_rows(spark, sf_dir), "raw_id")
    held.delete(ledger(spark, sf_dir).filter("statement_id % 4 = 1").select("raw_id"))
    held.upsert(new_rows(spark, sf_dir).filter("raw_id % 8 = 0"), tables.upsert_rows)
    held.delete(ledger(spark, sf_dir).filter("id % 7 = 3").select("raw_id"))
    before = held.read()
    held.compact()
    return money_out(held.read().join(before.select("raw_id"), "raw_id", "left_semi"))


def widened(spark, sf_dir):
    """Whole dollars as int, then a batch that needs more room and a note."""
    rows = ledger(spark, sf_dir)
    held = keyed(spark, rows.filter("id % 2 = 0").select("raw_id", F.col("amount").cast("int").alias("dollars")),
                 "raw_id")
    held.evolve(add={"note": "string"}, widen={"dollars": "bigint"})
    held.upsert(rows.filter("id % 4 <> 2").select(
        "raw_id", (F.col("amount").cast("int").cast("long") + 10_000_000_000).alias("dollars"),
        F.lit("late").alias("note")), tables.upsert_rows)
    return held.read()


add("s18_bucket_upsert", bucket_upsert, f"""
WITH {OLD_NEW} SELECT raw_id, COALESCE(o.date, n.date) AS date,
  COALESCE(o.description, n.description) AS description,
  CAST(COALESCE(o.amount, n.amount) AS DOUBLE) AS amount,
  COALESCE(n.category, o.category) AS category,
  CASE WHEN n.category IS NOT NULL THEN n.merchant_name ELSE o.merchant_name END AS merchant_name,
  COALESCE(n.confidence_score, o.confidence_score) AS confidence_score
FROM old o FULL JOIN new n USING (raw_id)""", "ledger")

add("s19_bucket_replace", bucket_replace, f"""
WITH {OLD_NEW} SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM (
  SELECT * FROM old WHERE raw_id NOT IN (SELECT raw_id FROM new) UNION ALL SELECT * FROM new)""",
    "ledger")

add("s20_bucket_insert_or_replace", bucket_insert_or_replace, """
WITH rows AS (SELECT raw_id, 'r' || raw_id AS reference, CAST(amount AS DOUBLE) AS amount, category
  FROM ledger),
new AS (SELECT raw_id, 'r' || (raw_id + 1) AS reference, amount, 'none' AS category FROM rows
  WHERE raw_id % 5 = 0)
SELECT * FROM rows WHERE raw_id % 3 <> 2 AND raw_id NOT IN (SELECT raw_id FROM new)
  AND reference NOT IN (SELECT reference FROM new)
UNION ALL SELECT * FROM new""", "ledger")

add("s24_marked_delete", marked_delete, f"""
WITH {OLD_NEW}, back AS (SELECT * FROM new WHERE raw_id % 8 = 0),
kept AS (SELECT * FROM old WHERE raw_id NOT IN (SELECT raw_id FROM ledger WHERE statement_id % 4 = 1)
  AND raw_id NOT IN (SELECT raw_id FROM back) UNION ALL SELECT * FROM back)
SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM kept WHERE raw_id % 7 <> 3""", "ledger")

add("s26_widened_columns", widened, """
WITH rows AS (SELECT raw_id, CAST(trunc(amount) AS BIGINT) AS dollars FROM ledger)
SELECT raw_id, dollars, CAST(NULL AS VARCHAR) AS note FROM rows WHERE raw_id % 4 = 2
UNION ALL SELECT raw_id, dollars + 10000000000, 'late' FROM rows WHERE raw_id % 4 <> 2""", "ledger")


def published(spark, sf_dir):
    """Two batches to two places, the second one twice; both hold the same rows."""
    base = scratch.shared_folder(spark)
    data = ledger(spark, sf_dir)
    for batch in (0, 1, 1):
        tables.publish_both(data.filter(F.col("id") % 2 == batch), f"{base}/one", f"{base}/two",
                            batch)
    one, two = (spark.read.parquet(f"{base}/{p}") for p in ("one", "two"))
    return money_out(one.join(two.select("id"), "id", "left_semi").drop("batch_id"))


add("s21_publish_both", published, f"SELECT {ROW} FROM ledger", "ledger")


def evolved(spark, sf_dir):
    old = ledger(spark, sf_dir).filter("id % 2 = 0").select("id", "description")
    new = ledger(spark, sf_dir).filter("id % 2 = 1").select("id", "description", "category")
    return tables.evolve(old, new)


add("s26_new_column", evolved, """
SELECT id, description, CASE WHEN id % 2 = 1 THEN category END AS category FROM ledger""",
    "ledger")


def incoming(spark, sf_dir):
    """Raw rows with gaps: no type, no category, no date, an odd type."""
    k = F.col("id") % 9
    return ledger(spark, sf_dir).select(
        "id", F.when(k != 1, F.col("date")).alias("date"),
        F.when(k != 2, F.col("description")).alias("description"),
        F.when(k != 3, F.col("amount")).alias("amount"),
        F.when(k == 4, "TRANSFER").when(k != 5, F.col("transaction_type"))
        .alias("transaction_type"),
        F.when(k != 6, F.col("category")).alias("category"))


def appended(spark, sf_dir):
    good, _ = tables.split_valid(incoming(spark, sf_dir))
    return money_out(good)


add("s15_append_with_defaults", appended, """
SELECT id, date, description, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN id % 9 = 5 THEN 'UNKNOWN' ELSE transaction_type END AS transaction_type,
  CASE WHEN id % 9 = 6 THEN 'Uncategorized' ELSE category END AS category,
  CAST(1.0 AS DOUBLE) AS confidence_score, '' AS merchant_name, '' AS raw_text
FROM ledger WHERE id % 9 NOT IN (1, 2, 3, 4)""", "ledger")


# ------------------------------------------------------------ rules
def invalid(spark, sf_dir):
    bad = validate.invalid_rows(incoming(spark, sf_dir).withColumn(
        "account_type", F.when(F.col("id") % 9 != 7, "savings").otherwise("brokerage")), bank=True)
    return bad.select("id", F.array_join("problems", "; ").alias("problems"))


add("v01_invalid_rows", invalid, """
SELECT id, CASE id % 9 WHEN 1 THEN 'date is missing' WHEN 2 THEN 'description is missing'
  WHEN 3 THEN 'amount is missing' WHEN 7 THEN 'account_type is unknown'
  ELSE 'transaction_type is unknown' END AS problems
FROM ledger WHERE id % 9 IN (1, 2, 3, 4, 5, 7)""", "ledger")

add("v02_repeated_hashes",
    lambda s, d: validate.repeated_keys(hashed_files(s, d), "file_hash"), f"""
WITH {HASHED} SELECT file_hash, COUNT(*) AS n FROM hashed GROUP BY 1 HAVING COUNT(*) > 1""",
    "statement_files")

add("v04_amount_problems",
    lambda s, d: validate.amount_problems(incoming(s, d).withColumn(
        "amount", F.when(F.col("id") % 9 == 8, -F.col("amount")).otherwise(F.col("amount"))))
    .select("id"), "SELECT id FROM ledger WHERE id % 9 IN (1, 2, 3, 8)", "ledger")

add("v05_loan_mismatches",
    lambda s, d: validate.loan_mismatches(loan(s, d).withColumn(
        "interest_amount", F.when(F.col("l_partkey") % 10 == 0, F.col("interest_amount") + 1)
        .otherwise(F.col("interest_amount")))).groupBy("loan_identifier").agg(
        F.count(F.lit(1)).alias("n")), """
SELECT loan_identifier, COUNT(*) AS n FROM loan WHERE l_partkey % 10 = 0 GROUP BY 1""", "loan")


# ------------------------------------------------------------ ingest
def ingested(spark, sf_dir):
    """Files in, statements, bank rows and loan rows out, in one pass."""
    from checks.statement_queries import dcu_lines
    from pennywright.plans.ingest import ingest_lines
    result = ingest_lines(dcu_lines(spark, sf_dir), "dcu")
    return tables.table_counts({"statements": result.statements, "bank": result.bank_rows,
                                "loans": result.loan_rows})


add("s08_ingest", ingested, """
SELECT 'statements' AS table_name,
  COUNT(DISTINCT CAST(statement_id * 10000 + year(date) AS BIGINT)) AS row_count FROM ledger
UNION ALL SELECT 'bank', COUNT(*) FROM ledger WHERE id % 6 <> 5
UNION ALL SELECT 'loans', COUNT(*) FROM ledger WHERE id % 6 = 5""", "ledger")
