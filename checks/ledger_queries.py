"""Card, bank and loan queries over orders, events and lineitem."""

from pyspark.sql import functions as F

from checks.catalog import add
from checks.views import ORDERS_AS_OF as AS_OF, card_feed, feed_ledger, ledger, loan
from pennywright.functions.money import dollars
from pennywright.operators import windows
from pennywright.plans import bank, card, common, registry

SPENT = "CAST(SUM(CASE WHEN transaction_type='DEBIT' THEN amount ELSE 0 END) AS DOUBLE)"
RECEIVED = "CAST(SUM(CASE WHEN transaction_type='CREDIT' THEN amount ELSE 0 END) AS DOUBLE)"
COUNT_SPENT_RECEIVED = (
    f"COUNT(*) AS transaction_count, {SPENT} AS total_spent, {RECEIVED} AS total_received"
)


def mean2(condition: str = "transaction_type='DEBIT'") -> str:
    """Average to cents, half up, in whole-number arithmetic."""
    cents = f"CAST(SUM(CASE WHEN {condition} THEN amount END) * 100 AS HUGEINT)"
    n = f"COUNT(CASE WHEN {condition} THEN 1 END)"
    return f"CAST((2 * {cents} + {n}) // (2 * NULLIF({n}, 0)) AS DOUBLE) / 100.0"


AVG_DEBIT = mean2()
MONTH = "strftime(date, '%Y-%m')"
NAMED = "merchant_name IS NOT NULL AND merchant_name <> ''"
FOUND = ("id, date, description, CAST(amount AS DOUBLE) AS amount, transaction_type, "
         "merchant_name, category, subcategory, bank_name, CAST(balance AS DOUBLE) AS balance, "
         "confidence_score")
ROW = ("id, raw_id, statement_id, bank_name, account_type, date, description, "
       "CAST(amount AS DOUBLE) AS amount, transaction_type, merchant_name, category, "
       "subcategory, CAST(balance AS DOUBLE) AS balance, confidence_score")


def money_out(df, *columns):
    """Decimals to doubles, as results leave the engine."""
    for c in columns or ("amount", "balance"):
        if c in df.columns:
            df = df.withColumn(c, dollars(F.col(c)))
    return df


# ------------------------------------------------------------ aggregations, card
add("a01_categories", lambda s, d: card.categories(ledger(s, d)), f"""
SELECT category, {COUNT_SPENT_RECEIVED} FROM ledger WHERE category IS NOT NULL
GROUP BY category""", "ledger")

add("a02_subcategories", lambda s, d: card.subcategories(ledger(s, d), "dining"), f"""
SELECT subcategory, {COUNT_SPENT_RECEIVED} FROM ledger
WHERE LOWER(category) = 'dining' AND subcategory IS NOT NULL GROUP BY subcategory""", "ledger")

add("a03_merchants", lambda s, d: card.merchants(ledger(s, d), 20), f"""
SELECT merchant_name, COUNT(*) AS transaction_count, {SPENT} AS total_spent,
  {AVG_DEBIT} AS avg_amount, MIN(date) AS first_seen, MAX(date) AS last_seen
FROM ledger WHERE {NAMED} GROUP BY merchant_name
ORDER BY transaction_count DESC, merchant_name LIMIT 20""", "ledger")

add("a04_spending_summary",
    lambda s, d: card.spending_summary(ledger(s, d, "1999-06-01", "1999-07-01"), "1999-06",
                                       "din"), f"""
SELECT {COUNT_SPENT_RECEIVED}, {AVG_DEBIT} AS avg_debit,
  CAST(MAX(amount) AS DOUBLE) AS largest_transaction, MIN(date) AS period_start,
  MAX(date) AS period_end, '1999-06' AS month, 'din' AS category_filter
FROM ledger WHERE {MONTH} = '1999-06' AND category ILIKE '%din%'""", "ledger")

add("a04_spending_summary_all", lambda s, d: card.spending_summary(ledger(s, d)), f"""
SELECT {COUNT_SPENT_RECEIVED}, {AVG_DEBIT} AS avg_debit,
  CAST(MAX(amount) AS DOUBLE) AS largest_transaction, MIN(date) AS period_start,
  MAX(date) AS period_end FROM ledger""", "ledger")

add("a05_spending_by_month", lambda s, d: card.spending_by_month(ledger(s, d), 6), f"""
SELECT {MONTH} AS month, {COUNT_SPENT_RECEIVED}, {AVG_DEBIT} AS avg_debit
FROM ledger GROUP BY 1 ORDER BY month DESC LIMIT 6""", "ledger")

add("a06_duplicate_charges", lambda s, d: card.duplicates(feed_ledger(s, d), 3), f"""
SELECT merchant_name, CAST(amount AS DOUBLE) AS amount, COUNT(*) AS occurrence_count,
  MIN(date) AS first_date, MAX(date) AS last_date,
  CAST(date_diff('day', MIN(date), MAX(date)) AS INTEGER) AS days_apart
FROM feed_ledger WHERE transaction_type = 'DEBIT' AND {NAMED} GROUP BY merchant_name, amount
HAVING COUNT(*) > 1 AND date_diff('day', MIN(date), MAX(date)) <= 3""", "feed_ledger")

add("a07_subcategory_stats", lambda s, d: card.subcategory_summary(ledger(s, d), "sub"), """
SELECT subcategory, category, COUNT(*) AS transaction_count,
  CAST(SUM(amount) AS DOUBLE) AS total_spent,
  CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_transaction,
  CAST(MIN(amount) AS DOUBLE) AS min_amount, CAST(MAX(amount) AS DOUBLE) AS max_amount
FROM ledger WHERE transaction_type = 'DEBIT' AND subcategory ILIKE '%sub%'
GROUP BY subcategory, category""", "ledger")

add("a08_bank_categories", lambda s, d: bank.categories(ledger(s, d), "checking"), f"""
SELECT category, {COUNT_SPENT_RECEIVED} FROM ledger WHERE account_type = 'checking'
GROUP BY category""", "ledger")

add("a09_bank_summary",
    lambda s, d: bank.summary(ledger(s, d, "1999-06-01", "1999-07-01"), "1999-06", "groc",
                              "savings"), f"""
SELECT {COUNT_SPENT_RECEIVED}, '1999-06' AS month, 'groc' AS category_filter,
  'savings' AS account_type
FROM ledger WHERE {MONTH} = '1999-06' AND category ILIKE '%groc%'
  AND account_type = 'savings'""", "ledger")

add("a10_bank_by_month", lambda s, d: bank.by_month(ledger(s, d), "savings", 12), f"""
SELECT {MONTH} AS month, {COUNT_SPENT_RECEIVED} FROM ledger WHERE account_type = 'savings'
GROUP BY 1 ORDER BY month DESC LIMIT 12""", "ledger")

add("a11_investment_summary",
    lambda s, d: bank.investment_summary(ledger(s, d, "1999-01-01", "2000-01-01"), "1999"), f"""
SELECT COUNT(*) AS transaction_count, {SPENT} AS total_invested, {RECEIVED} AS total_returned,
  CAST(SUM(CASE WHEN transaction_type='DEBIT' THEN amount ELSE 0 END)
     - SUM(CASE WHEN transaction_type='CREDIT' THEN amount ELSE 0 END) AS DOUBLE) AS net_outflow,
  MIN(date) AS first_date, MAX(date) AS last_date, '1999' AS year_filter
FROM ledger WHERE category ILIKE '%investment%' AND strftime(date, '%Y') = '1999'""", "ledger")

add("a11_investment_rows",
    lambda s, d: money_out(bank.investment_rows(ledger(s, d, "1999-06-01", "1999-07-01"),
                                                month="1999-06")), f"""
SELECT id, date, description, CAST(NULL AS VARCHAR) AS clean_description,
  CAST(amount AS DOUBLE) AS amount, transaction_type, category, account_type, bank_name
FROM ledger WHERE category ILIKE '%investment%' AND {MONTH} = '1999-06'
ORDER BY date DESC, id LIMIT 200""", "ledger")

LOAN_SUMS = """CAST(SUM(payment_amount) AS DOUBLE) AS total_payment,
  CAST(SUM(principal_amount) AS DOUBLE) AS total_principal,
  CAST(SUM(interest_amount) AS DOUBLE) AS total_interest"""

add("a12_loan_summary", lambda s, d: bank.loan_summary(loan(s, d), 12), f"""
SELECT {MONTH} AS month, COUNT(*) AS payment_count, {LOAN_SUMS},
  CAST(MIN(balance) AS DOUBLE) AS ending_balance
FROM loan GROUP BY 1 ORDER BY month DESC LIMIT 12""", "loan")

add("a18_ledger_stats", lambda s, d: card.stats(ledger(s, d)), f"""
SELECT COUNT(*) AS total, COALESCE({SPENT}, 0) AS total_debits,
  COALESCE({RECEIVED}, 0) AS total_credits,
  COALESCE(CAST(SUM(CASE WHEN transaction_type='DEBIT' THEN amount END) AS DOUBLE)
    / NULLIF(COUNT(CASE WHEN transaction_type='DEBIT' THEN 1 END), 0), 0) AS avg_debit,
  COALESCE(CAST(MAX(amount) AS DOUBLE), 0) AS largest_transaction,
  CAST(SUM(CASE WHEN transaction_type='CREDIT' THEN amount ELSE 0 END)
     - SUM(CASE WHEN transaction_type='DEBIT' THEN amount ELSE 0 END) AS DOUBLE) AS net
FROM ledger""", "ledger")

add("a19_monthly", lambda s, d: card.monthly(ledger(s, d)), f"""
SELECT {MONTH} AS month, {SPENT} AS spending, {RECEIVED} AS income,
  COUNT(*) AS transaction_count FROM ledger GROUP BY 1""", "ledger")

add("a22_signed_spend", lambda s, d: card.signed_spend(card_feed(s, d)), """
SELECT category, CAST(SUM(ABS(amount)) AS DOUBLE) AS total FROM card_feed WHERE amount < 0
GROUP BY category""", "card_feed")

add("a25_known_categories", lambda s, d: card.known_categories(ledger(s, d)), f"""
SELECT category, {SPENT} AS total_spent, {RECEIVED} AS total_received,
  COUNT(*) AS transaction_count
FROM ledger WHERE category <> 'Uncategorized' GROUP BY category""", "ledger")

add("a26_merchants_by_spend", lambda s, d: card.merchants_by_spend(ledger(s, d), 10), f"""
SELECT merchant_name, {SPENT} AS total_spent, COUNT(*) AS transaction_count
FROM ledger WHERE merchant_name IS NOT NULL GROUP BY merchant_name
ORDER BY total_spent DESC, merchant_name LIMIT 10""", "ledger")

add("a27_overall", lambda s, d: card.overall(ledger(s, d)), f"""
SELECT {SPENT} AS total_spent, {RECEIVED} AS total_received, COUNT(*) AS total_transactions,
  COUNT(DISTINCT {MONTH}) AS months_of_data FROM ledger""", "ledger")

add("a28_top_categories_of_year",
    lambda s, d: card.top_categories_of_year(ledger(s, d, "1999-01-01", "2000-01-01"), AS_OF), """
SELECT category, CAST(SUM(amount) AS DOUBLE) AS total FROM ledger
WHERE transaction_type = 'DEBIT' AND strftime(date, '%Y') = '1999' GROUP BY category
ORDER BY total DESC, category LIMIT 5""", "ledger")

add("a29_merchant_by_month",
    lambda s, d: card.merchant_by_month(ledger(s, d, "1999-01-01", "2000-01-01"), "amazon",
                                        "1999"), f"""
SELECT {MONTH} AS month, CAST(SUM(amount) AS DOUBLE) AS total_spent FROM ledger
WHERE transaction_type = 'DEBIT' AND strftime(date, '%Y') = '1999'
  AND (merchant_name ILIKE '%amazon%' OR merchant_name ILIKE '%amzn%'
    OR description ILIKE '%amazon%' OR description ILIKE '%amzn%')
GROUP BY 1""", "ledger")

add("a30_duplicates_last_month",
    lambda s, d: card.duplicates_last_month(feed_ledger(s, d, "2024-01-01", "2024-02-01"),
                                            "2024-02-10"), """
SELECT merchant_name, CAST(amount AS DOUBLE) AS amount, COUNT(*) AS cnt FROM feed_ledger
WHERE transaction_type = 'DEBIT' AND date >= DATE '2024-01-01' AND date < DATE '2024-02-01'
GROUP BY merchant_name, amount HAVING COUNT(*) > 1""", "feed_ledger")

add("a31_period_totals",
    lambda s, d: card.period_totals(ledger(s, d, "1999-01-01"), AS_OF, "Transportation",
                                    "Sub 1"), """
SELECT CAST(SUM(CASE WHEN transaction_type = 'DEBIT' AND date >= DATE '1999-06-01'
    AND date < DATE '1999-07-01' THEN amount END) AS DOUBLE) AS spent_last_month,
  CAST(SUM(CASE WHEN transaction_type = 'CREDIT' AND date >= DATE '1999-07-01'
    THEN amount END) AS DOUBLE) AS received_this_month,
  CAST(SUM(CASE WHEN transaction_type = 'DEBIT' AND category = 'Transportation'
    AND subcategory = 'Sub 1' AND strftime(date, '%Y') = '1999' THEN amount END) AS DOUBLE)
    AS leaf_this_year
FROM ledger""", "ledger")

add("a32_busiest_bank",
    lambda s, d: card.busiest_bank(ledger(s, d, "1999-06-01", "1999-07-01"), AS_OF), """
SELECT bank_name, COUNT(*) AS txn_count FROM ledger
WHERE date >= DATE '1999-06-01' AND date < DATE '1999-07-01' GROUP BY bank_name
ORDER BY txn_count DESC, bank_name LIMIT 1""", "ledger")

add("a33_account_types", lambda s, d: bank.account_types(ledger(s, d)), f"""
SELECT account_type, {SPENT} AS total_spent, {RECEIVED} AS total_received,
  COUNT(*) AS transaction_count FROM ledger GROUP BY account_type""", "ledger")

add("a34_loan_totals", lambda s, d: bank.loan_totals(loan(s, d)), f"""
SELECT COUNT(*) AS payment_count, {LOAN_SUMS} FROM loan""", "loan")

# ------------------------------------------------------------ filters
add("p01_ledger_routing",
    lambda s, d: card.categories(common.active_ledger(
        ledger(s, d).filter("confidence_score > 2"), ledger(s, d))), f"""
SELECT category, {COUNT_SPENT_RECEIVED} FROM ledger WHERE category IS NOT NULL
GROUP BY category""", "ledger")

add("p02_find_transactions",
    lambda s, d: money_out(card.find(
        ledger(s, d, "1997-01-01", "2000-01-01"), merchant="merchant 1", category="in",
        start_date="1997-01-01", end_date="1999-12-31", min_amount=1000, max_amount=400000,
        transaction_type="debit", bank_name="CITI", limit=500)), f"""
SELECT {FOUND} FROM ledger WHERE merchant_name ILIKE '%merchant 1%' AND category ILIKE '%in%'
  AND date >= DATE '1997-01-01' AND date <= DATE '1999-12-31' AND amount >= 1000
  AND amount <= 400000 AND transaction_type = 'DEBIT' AND bank_name = 'citi'
ORDER BY date DESC, id LIMIT 100""", "ledger")

add("p03_find_bank_transactions",
    lambda s, d: money_out(bank.find(ledger(s, d), account_type="checking", category="groc",
                                     start_date="1996-01-01", end_date="2000-12-31",
                                     min_amount=10.5, transaction_type="CREDIT",
                                     description="star", bank_name="citi")), f"""
SELECT {ROW} FROM ledger WHERE account_type = 'checking' AND category ILIKE '%groc%'
  AND date >= DATE '1996-01-01' AND date <= DATE '2000-12-31' AND amount >= 10.5
  AND transaction_type = 'CREDIT' AND description ILIKE '%star%' AND bank_name = 'citi'
ORDER BY date DESC, id LIMIT 50""", "ledger")

BY_CATEGORY = ("id, date, description, CAST(NULL AS VARCHAR) AS clean_description, "
               "CAST(amount AS DOUBLE) AS amount, transaction_type, category, account_type, "
               "bank_name, CAST(balance AS DOUBLE) AS balance")
add("p04_bank_rows_by_category",
    lambda s, d: money_out(bank.by_category(
        ledger(s, d, "1999-06-01", "1999-07-01"), "groc", year="1998", month="1999-06-15",
        account_type="checking", transaction_type="debit", limit=999)), f"""
SELECT {BY_CATEGORY} FROM ledger WHERE category ILIKE '%groc%' AND {MONTH} = '1999-06'
  AND account_type = 'checking' AND transaction_type = 'DEBIT'
ORDER BY date DESC, id LIMIT 200""", "ledger")

add("p05_ledger_list",
    lambda s, d: money_out(card.listing(ledger(s, d), 100, "credit", "1998-01-01", "1998-12-31",
                                        "merchant", "BOFA")), f"""
SELECT {ROW} FROM ledger WHERE transaction_type = 'CREDIT' AND date >= DATE '1998-01-01'
  AND date <= DATE '1998-12-31' AND merchant_name ILIKE '%merchant%' AND bank_name = 'bofa'
ORDER BY date DESC, id LIMIT 100""", "ledger")

add("p06_rows_by_merchant", lambda s, d: money_out(card.by_merchant(ledger(s, d),
                                                                    "Merchant 77")), f"""
SELECT {ROW} FROM ledger WHERE merchant_name ILIKE '%Merchant 77%'""", "ledger")

add("p06_merchant_total", lambda s, d: card.merchant_total(ledger(s, d), "Merchant 77"), """
SELECT COUNT(*) AS transaction_count, CAST(SUM(amount) AS DOUBLE) AS total FROM ledger
WHERE merchant_name ILIKE '%Merchant 77%'""", "ledger")

add("p07_card_gaps", lambda s, d: money_out(card.uncategorized(ledger(s, d), 20)), """
SELECT id, date, description, CAST(amount AS DOUBLE) AS amount, transaction_type, merchant_name,
  category, bank_name
FROM ledger WHERE (category = 'Uncategorized' OR category IS NULL OR merchant_name IS NULL
  OR merchant_name = '') AND transaction_type = 'DEBIT'
ORDER BY ledger.amount DESC, id LIMIT 20""", "ledger")

add("p08_bank_gaps", lambda s, d: money_out(bank.uncategorized(ledger(s, d), "savings", 50)), f"""
SELECT {ROW} FROM ledger WHERE category = 'Uncategorized' AND transaction_type = 'DEBIT'
  AND account_type = 'savings' ORDER BY ledger.amount DESC, id LIMIT 50""", "ledger")

LOAN_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "payment_amount", "balance"]
add("p09_loan_rows",
    lambda s, d: money_out(
        bank.loan_rows(loan(s, d, "1998-01-01", "1998-07-01"), "1998-01-01", "1998-06-30", 500,
                       LOAN_KEYS),
        "payment_amount", "principal_amount", "interest_amount", "balance"), """
SELECT date, loan_identifier, CAST(payment_amount AS DOUBLE) AS payment_amount,
  CAST(principal_amount AS DOUBLE) AS principal_amount,
  CAST(interest_amount AS DOUBLE) AS interest_amount, CAST(balance AS DOUBLE) AS balance,
  l_orderkey, l_linenumber, l_partkey
FROM loan WHERE date >= DATE '1998-01-01' AND date <= DATE '1998-06-30'
ORDER BY date DESC, l_orderkey, l_linenumber, l_partkey, loan.payment_amount, loan.balance
LIMIT 100""", "loan")

add("p13_low_confidence", lambda s, d: card.low_confidence(ledger(s, d)), """
SELECT id, date, description, merchant_name, category, confidence_score FROM ledger
WHERE confidence_score < 0.5 ORDER BY confidence_score, id LIMIT 10""", "ledger")

add("p14_merchant_spellings",
    lambda s, d: money_out(card.merchant_charges(
        ledger(s, d, "1999-06-01", "1999-07-01"), "Starbucks", "1999-06-01", "1999-06-30")), """
SELECT id, date, description, merchant_name, CAST(amount AS DOUBLE) AS amount FROM ledger
WHERE transaction_type = 'DEBIT' AND date BETWEEN DATE '1999-06-01' AND DATE '1999-06-30'
  AND (merchant_name ILIKE '%starbucks%' OR merchant_name ILIKE '%sbux%'
    OR description ILIKE '%starbucks%' OR description ILIKE '%sbux%')""", "ledger")

add("p15_term_charges",
    lambda s, d: money_out(card.term_charges(ledger(s, d, "1999-01-01", "2000-01-01"),
                                             "transportation", AS_OF)), """
SELECT id, date, merchant_name, category, CAST(amount AS DOUBLE) AS amount FROM ledger
WHERE transaction_type = 'DEBIT' AND category = 'Transportation'
  AND strftime(date, '%Y') = '1999'""", "ledger")

add("p15_in_categories",
    lambda s, d: money_out(card.in_categories(ledger(s, d), ["Food & Dining", "Groceries",
                                                             "Restaurants"], 20)), """
SELECT id, date, description, CAST(amount AS DOUBLE) AS amount, merchant_name, category
FROM ledger WHERE category IN ('Food & Dining', 'Groceries', 'Restaurants')
ORDER BY date DESC, id LIMIT 20""", "ledger")

WINDOWS_SQL = f"""
SELECT CASE WHEN date >= DATE '1999-07-01' THEN 'this month' ELSE 'last month' END AS period,
  {COUNT_SPENT_RECEIVED} FROM ledger
WHERE date >= DATE '1999-06-01' AND date <= DATE '1999-07-15' GROUP BY 1"""


def relative_periods(spark, sf_dir):
    from pennywright.functions import dates
    rows = ledger(spark, sf_dir, "1999-06-01", "1999-07-16")
    label = F.when(dates.this_month(F.col("date"), AS_OF), "this month").when(
        dates.last_month(F.col("date"), AS_OF), "last month")
    return rows.groupBy(label.alias("period")).agg(
        common.row_count(), common.spent(), common.received())


add("p16_relative_dates", relative_periods, WINDOWS_SQL, "ledger")


def free_sql(spark, sf_dir):
    from pennywright.operators.free_sql import query
    return query(spark, """
        SELECT bank_name, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total
        FROM ledger WHERE amount > :least GROUP BY bank_name""",
                 {"ledger": ledger(spark, sf_dir)}, {"least": 1000})


add("p17_free_sql", free_sql, """
SELECT bank_name, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total FROM ledger
WHERE amount > 1000 GROUP BY bank_name""", "ledger")

# ------------------------------------------------------------ joins and windows
BALANCES = """
SELECT id, account_type, date, CAST(balance AS DOUBLE) AS balance, description FROM ledger l
WHERE balance IS NOT NULL AND date = (SELECT MAX(date) FROM ledger t
  WHERE t.account_type = l.account_type AND t.balance IS NOT NULL)"""
add("j04_latest_balance", lambda s, d: money_out(bank.balances(ledger(s, d))), BALANCES, "ledger")


def latest_by_rank(spark, sf_dir):
    rows = ledger(spark, sf_dir).filter("balance IS NOT NULL").select(
        "id", "account_type", "date", "balance", "description")
    return money_out(windows.latest_rows_by_rank(rows, ["account_type"], "date"))


add("w01_latest_with_ties", latest_by_rank, BALANCES, "ledger")

# ------------------------------------------------------------ sort and limit
add("l01_capped_limit",
    lambda s, d: card.merchants(ledger(s, d), 5000).select("merchant_name",
                                                           "transaction_count"), f"""
SELECT merchant_name, COUNT(*) AS transaction_count FROM ledger WHERE {NAMED}
GROUP BY merchant_name ORDER BY transaction_count DESC, merchant_name LIMIT 100""", "ledger")

add("l02_largest", lambda s, d: money_out(card.largest(ledger(s, d))), f"""
SELECT {ROW} FROM ledger ORDER BY ledger.amount DESC, id LIMIT 1""", "ledger")

# ------------------------------------------------------------ combined ledgers


def combined_view(spark, sf_dir):
    both = card.combined(feed_ledger(spark, sf_dir), ledger(spark, sf_dir))
    return both.groupBy("ledger", "category").agg(common.row_count(), common.spent())


add("x03_combined_ledgers", combined_view, f"""
SELECT 'card' AS ledger, category, COUNT(*) AS transaction_count, {SPENT} AS total_spent
FROM feed_ledger GROUP BY category UNION ALL
SELECT 'bank', category, COUNT(*), {SPENT} FROM ledger GROUP BY category""",
    "ledger feed_ledger")

add("u03_named_registry", lambda s, d: registry.run("card.categories", ledger(s, d)), f"""
SELECT category, {COUNT_SPENT_RECEIVED} FROM ledger WHERE category IS NOT NULL
GROUP BY category""", "ledger")
