"""Statement text: lines and files derived from orders, parsed back into rows."""

from pyspark.sql import functions as F

from checks.catalog import add
from checks.ledger_queries import money_out
from checks.views import ledger, statement_files
from checks import rules_sql as sql
from pennywright.functions import fixed_values as fv
from pennywright.operators import statements as st, windows
from pennywright.sources import statement_text as text_source

SECTION = 1 << 40


def _file_key():
    return (F.floor(F.col("statement_id")) * 10000 + F.year("date")).cast("long")


def _amount(column="amount", signed=True):
    sign = F.when(F.col("transaction_type") == "DEBIT", "-").otherwise(F.lit(""))
    number = F.format_number(F.col(column), 2)
    return F.concat(sign, number) if signed else number


def _balance():
    return F.format_number(F.coalesce("balance", F.col("id").cast("decimal(18,2)")), 2)


def _lines(rows, section, *texts):
    """(file_id, line_no, line) from a section number and texts per ledger row."""
    parts = F.array(*[F.struct(F.lit(k).alias("k"), t.alias("line"))
                      for k, t in enumerate(texts)])
    return rows.select(_file_key().alias("file_id"), "id", section.alias("s"),
                       F.explode(parts).alias("p")).filter("p.line IS NOT NULL").select(
        "file_id", (F.col("s") * SECTION + (F.col("id") + 1) * 8 + F.col("p.k")).cast("long")
        .alias("line_no"), F.col("p.line").alias("line"))


def _heads(rows, heads):
    """Header lines of every file: (section number, place in it, text)."""
    files = rows.select(_file_key().alias("file_id"), F.year("date").alias("y")).distinct()
    parts = F.array(*[F.struct(F.lit(s * SECTION + k).cast("long").alias("line_no"),
                               t.alias("line")) for s, k, t in heads])
    return files.select("file_id", F.explode(parts).alias("p")).select(
        "file_id", "p.line_no", "p.line")


# ------------------------------------------------------------ credit union
def dcu_lines(spark, sf_dir):
    """Statements per customer group and year: savings, checking, loan, legal text."""
    rows = ledger(spark, sf_dir)
    key = F.col("id")
    day = F.upper(F.date_format("date", "MMMdd"))
    kind = F.when(key % 6 == 5, 3).when(F.col("account_type") == "savings", 1).otherwise(2)
    principal = F.format_number((F.col("amount") * F.lit("0.90").cast("decimal(4,2)"))
                                .cast("decimal(18,2)"), 2)
    entry = F.when(kind == 3, F.concat_ws(" ", day, F.lit("LOAN PAYMENT"), _amount(signed=False),
                                          F.concat(F.lit("-"), principal), _balance())
                   ).otherwise(F.concat_ws(" ", day, "description", _amount(), _balance()))
    checking = kind == 2
    body = _lines(
        rows, kind, entry,
        F.when(checking & (key % 3 == 1), F.concat(F.lit("REF "), key.cast("string"))),
        F.when(checking & (key % 7 == 0), F.lit("JAN03 2,644.58 JAN17 2,692.55")),
        F.when(checking & (key % 7 == 0), F.lit("AFTER THE SUMMARY")),
        F.when(checking & (key % 5 == 0), F.lit("TOTAL DEPOSITS 1.00 2.00")),
        F.when(checking & (key % 5 == 0), F.lit("STRAY NOTE")),
        F.when(checking & (key % 11 == 0), F.lit("JAN09 ONLY ONE 5.00")),
        F.when(checking & (key % 11 == 0), F.lit("CLOSED NOTE")),
    )
    year = F.lpad((F.col("y") % 100).cast("string"), 2, "0")
    heads = _heads(rows, [
        (0, 1, F.lit("JAN02 NOT IN A SECTION 1.00 2.00")),
        (0, 2, F.concat(F.lit("STATEMENT 01-01-"), year, F.lit(" to 12-31-"), year)),
        (1, 0, F.lit("PRIMARY SAVINGS ACCT# 1")),
        (1, 1, F.lit("PREVIOUS BALANCE 5,000.00")),
        (2, 0, F.lit("FREE CHECKING ACCT# 2")),
        (3, 0, F.lit("NEW VEHICLE LOAN# 142 PREVIOUS BALANCE 19,000.00")),
        (4, 0, F.lit("BILLING RIGHTS SUMMARY")),
        (4, 1, F.lit("JAN05 LEGAL TEXT 1.00 2.00 3.00")),
    ])
    return body.unionByName(heads)


BAL = "CAST(COALESCE(balance, CAST(id AS DECIMAL(18,2))) AS DOUBLE)"
FILE = "CAST(statement_id * 10000 + year(date) AS BIGINT)"
SIGN_KIND = "CASE WHEN transaction_type = 'DEBIT' THEN 'DEBIT' ELSE 'CREDIT' END"
OUT = ["file_id", "date", "description", "amount", "transaction_type", "balance"]

add("t01_dcu_savings",
    lambda s, d: money_out(st.dcu_savings(dcu_lines(s, d)).select(*OUT, "account_type")), f"""
SELECT {FILE} AS file_id, date, trim(description) AS description, CAST(amount AS DOUBLE) AS amount,
  {SIGN_KIND} AS transaction_type, {BAL} AS balance, 'savings' AS account_type
FROM ledger WHERE id % 6 <> 5 AND account_type = 'savings'""", "ledger")

add("t02_dcu_checking",
    lambda s, d: money_out(st.dcu_checking(dcu_lines(s, d)).select(*OUT, "account_type")), f"""
SELECT {FILE} AS file_id, date,
  trim(description) || CASE WHEN id % 3 = 1 OR id % 7 = 0 THEN ' | ' ELSE '' END
    || concat_ws(' ', CASE WHEN id % 3 = 1 THEN 'REF ' || CAST(id AS VARCHAR) END,
       CASE WHEN id % 7 = 0 THEN 'AFTER THE SUMMARY' END) AS description,
  CAST(amount AS DOUBLE) AS amount, {SIGN_KIND} AS transaction_type, {BAL} AS balance,
  'checking' AS account_type
FROM ledger WHERE id % 6 <> 5 AND account_type = 'checking'""", "ledger")

PRINCIPAL = "CAST(amount * CAST(0.90 AS DECIMAL(4,2)) AS DECIMAL(18,2))"
add("t03_dcu_loan",
    lambda s, d: money_out(st.dcu_loan(dcu_lines(s, d)).select(
        "file_id", "loan_identifier", "date", "description", "payment_amount",
        "principal_amount", "interest_amount", "balance"),
        "payment_amount", "principal_amount", "interest_amount", "balance"), f"""
SELECT {FILE} AS file_id, 'NEW VEHICLE LOAN# 142' AS loan_identifier, date,
  'LOAN PAYMENT' AS description, CAST(amount AS DOUBLE) AS payment_amount,
  CAST({PRINCIPAL} AS DOUBLE) AS principal_amount,
  CAST(amount - {PRINCIPAL} AS DOUBLE) AS interest_amount, {BAL} AS balance
FROM ledger WHERE id % 6 = 5""", "ledger")

add("w03_section_carry_forward",
    lambda s, d: st.dcu_sections(dcu_lines(s, d)).groupBy("file_id", "section").agg(
        F.count(F.lit(1)).alias("n_lines")), f"""
WITH l AS (SELECT {FILE} AS file_id, id, CASE WHEN id % 6 = 5 THEN 'loan' ELSE account_type END
  AS section FROM ledger)
SELECT file_id, section, CAST(SUM(CASE WHEN section = 'checking' THEN 1
  + CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 2 ELSE 0 END
  + CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END
  ELSE 1 END) + CASE WHEN section IN ('savings', 'loan') THEN 1 ELSE 0 END AS BIGINT) AS n_lines
FROM l GROUP BY file_id, section UNION ALL
SELECT f.file_id, s.section, CAST(1 AS BIGINT) FROM (SELECT DISTINCT file_id FROM l) f
  CROSS JOIN (VALUES ('savings'), ('loan')) s(section)
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.file_id = f.file_id AND l.section = s.section)""",
    "ledger")


def continuation_groups(spark, sf_dir):
    rows = st.dcu_checking(dcu_lines(spark, sf_dir))
    joined = F.col("description").contains(" | ")
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count(F.when(joined, 1)).alias("n_continued"))


add("w04_continuation_lines", continuation_groups, f"""
SELECT {FILE} AS file_id, COUNT(*) AS n_rows,
  COUNT(CASE WHEN id % 3 = 1 OR id % 7 = 0 THEN 1 END) AS n_continued
FROM ledger WHERE id % 6 <> 5 AND account_type = 'checking' GROUP BY 1""", "ledger")


def dcu_all(spark, sf_dir):
    lines = dcu_lines(spark, sf_dir)
    return lines, st.bank_rows({"dcu": lines})


add("x01_savings_and_checking",
    lambda s, d: money_out(dcu_all(s, d)[1].groupBy("account_type", "transaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))), f"""
SELECT account_type, {SIGN_KIND} AS transaction_type, COUNT(*) AS n,
  CAST(SUM(amount) AS DOUBLE) AS amount FROM ledger WHERE id % 6 <> 5 GROUP BY 1, 2""", "ledger")

add("t11_statement_periods", lambda s, d: st.periods(dcu_lines(s, d), "dcu"), f"""
SELECT DISTINCT {FILE} AS file_id, make_date(year(date), 1, 1) AS period_start,
  make_date(year(date), 12, 31) AS period_end FROM ledger""", "ledger")


def dcu_metadata(spark, sf_dir):
    lines, rows = dcu_all(spark, sf_dir)
    files = lines.select("file_id").distinct().withColumn(
        "filename", F.concat(F.lit("stmt_"), F.col("file_id").cast("string"), F.lit(".txt")))
    meta = st.statement_metadata(files, lines, rows, "dcu", st.dcu_loan(lines))
    return money_out(meta, "total_debits", "total_credits")


add("t12_statement_metadata", dcu_metadata, f"""
SELECT {FILE} AS file_id, 'stmt_' || CAST({FILE} AS VARCHAR) || '.txt' AS filename,
  'dcu' AS bank_name, MIN(make_date(year(date), 1, 1)) AS statement_period_start,
  MIN(make_date(year(date), 12, 31)) AS statement_period_end, COUNT(*) AS total_transactions,
  CAST(SUM(CASE WHEN id % 6 <> 5 AND transaction_type = 'DEBIT' THEN amount ELSE 0 END) AS DOUBLE)
    AS total_debits,
  CAST(SUM(CASE WHEN id % 6 <> 5 AND transaction_type <> 'DEBIT' THEN amount ELSE 0 END) AS DOUBLE)
    AS total_credits
FROM ledger GROUP BY 1""", "ledger")


# ------------------------------------------------------------ national bank
def boa_lines(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    key, kind = F.col("id"), F.col("transaction_type")
    day = F.date_format("date", "MM/dd/yy")
    section = F.when(kind == "CREDIT", 1).when(kind == "DEBIT", 2).otherwise(3)
    balance = F.when(key % 2 == 0, _balance())
    what = F.when(kind == "UNKNOWN", key.cast("string")).otherwise(F.col("description"))
    body = _lines(
        rows, section,
        F.concat_ws(" ", day, what, _amount(), balance),
        F.when(key % 3 == 1, F.concat(F.lit("ID:"), key.cast("string"))),
        F.when(key % 4 == 1, F.lit("Bank of America Account # 4870 0377")),
        F.when(key % 4 == 1, F.lit("CO ID:77")),
        F.when(key % 5 == 0, F.lit("continued on the next page")),
        F.when(key % 5 == 0, F.lit("STRAY NOTE")),
        F.when(key % 11 == 0, F.concat_ws(" ", day, F.lit("no amount here"))),
        F.when(key % 11 == 0, F.lit("CLOSED NOTE")),
    )
    heads = _heads(rows, [
        (0, 0, F.lit("03/19/26 BEFORE ANY SECTION 5.00")),
        (0, 1, F.concat(F.lit("for January 1, "), F.col("y").cast("string"),
                        F.lit(" to December 31, "), F.col("y").cast("string"))),
        (1, 0, F.lit("Deposits and other additions")),
        (2, 0, F.lit("Withdrawals and other subtractions")),
        (3, 0, F.lit("Checks")),
    ])
    return body.unionByName(heads)


add("t04_boa", lambda s, d: money_out(st.boa(boa_lines(s, d)).select(*OUT)), f"""
SELECT {FILE} AS file_id, date, CASE WHEN transaction_type = 'UNKNOWN' THEN
    'Check #' || CAST(id AS VARCHAR) ELSE trim(description)
    || CASE WHEN id % 3 = 1 OR id % 4 = 1 THEN ' | ' ELSE '' END
    || concat_ws(' ', CASE WHEN id % 3 = 1 THEN 'ID:' || CAST(id AS VARCHAR) END,
       CASE WHEN id % 4 = 1 THEN 'CO ID:77' END) END AS description,
  CAST(amount AS DOUBLE) AS amount,
  CASE WHEN transaction_type = 'CREDIT' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
  CASE WHEN id % 2 = 0 THEN {BAL} END AS balance FROM ledger""", "ledger")


# ------------------------------------------------------------ marker-delimited
def chase_lines(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    key = F.col("id")
    day = F.date_format("date", "MM/dd")
    posted = F.when(key % 2 == 0, day)
    label = F.when(key % 5 == 0, F.lit("Transaction#:"))
    body = _lines(
        rows, F.lit(1),
        F.concat_ws(" ", day, posted, "description", label, _amount(), _balance()),
        F.when(key % 3 == 1, F.concat(F.lit("PPD ID: "), key.cast("string"))),
        F.when(key % 3 == 1, F.lit("January 1, 1999throughDecember 31, 1999")),
        F.when(key % 6 == 1, F.lit("SECOND LINE")),
        F.when(key % 7 == 0, F.lit("Page 2 of 4")),
        F.when(key % 7 == 0, F.lit("STRAY NOTE")),
        F.when(key % 11 == 0, F.concat_ws(" ", day, F.lit("no balance 5.00"))),
        F.when(key % 11 == 0, F.lit("CLOSED NOTE")),
    )
    year = F.col("y").cast("string")
    heads = _heads(rows, [
        (0, 0, F.lit("01/02 OUTSIDE 1.00 2.00")),
        (0, 1, F.concat(F.lit("January 1, "), year, F.lit("throughDecember 31, "), year)),
        (1, 0, F.lit("*start*transaction detail")),
        (1, 1, F.lit("DATE  DESCRIPTION  AMOUNT  BALANCE")),
        (2, 0, F.lit("*END*Transaction Detail")),
        (2, 1, F.lit("01/02 OUTSIDE AGAIN 1.00 2.00")),
    ])
    return body.unionByName(heads)


add("t05_chase", lambda s, d: money_out(st.chase(chase_lines(s, d)).select(*OUT)), f"""
SELECT {FILE} AS file_id, date, concat_ws(' | ', trim(description),
    CASE WHEN id % 3 = 1 THEN 'PPD ID: ' || CAST(id AS VARCHAR) END,
    CASE WHEN id % 6 = 1 THEN 'SECOND LINE' END) AS description,
  CAST(amount AS DOUBLE) AS amount, {SIGN_KIND} AS transaction_type, {BAL} AS balance
FROM ledger""", "ledger")


# ------------------------------------------------------------ card statements
ISSUERS = ["robinhood", "citi", "bofa", "capital_one", "wells_fargo", "citi"]


def card_files(spark, sf_dir):
    """One small card statement per order; issuer by order, the sixth kind is empty.

    The ledger is dealt out first, as its few file splits become many times their size.
    """
    rows = ledger(spark, sf_dir).repartition("id")
    k = F.col("id") % 6
    slashed = F.date_format("date", "MM/dd")
    named = F.date_format("date", "MMM d")
    number = F.format_number("amount", 2)
    credit = F.col("transaction_type") == "CREDIT"
    minus = F.when(credit, "-").otherwise(F.lit(""))
    what = F.regexp_replace("description", r"\s+", " ")
    entry = (
        F.when(k == 0, F.concat_ws(" ", slashed, slashed, F.lit("AB12345678XYZ"), what,
                                   F.concat(number, minus)))
        .when(k == 1, F.concat_ws(" ", slashed, F.when(F.col("id") % 4 == 1, slashed), what,
                                  F.concat(minus, F.lit("$"), number),
                                  F.lit("Eligible Purchases: $750.49")))
        .when(k == 2, F.concat_ws(" ", slashed, slashed, what, F.lit("1234 5678"),
                                  F.concat(minus, number)))
        .when(k == 3, F.concat_ws(" ", named, named, what,
                                  F.concat(F.when(credit, "- ").otherwise(F.lit("")), F.lit("$"),
                                           number)))
        .when(k == 4, F.concat_ws(" ", F.date_format("date", "MM/dd/yyyy"), what,
                                  F.concat(F.lit("$"), number)))
    )
    sign = F.element_at(F.array(*[F.lit(x) for x in (
        "Robinhood Gold Card", "citicards.com", "bankofamerica.com", "capitalone.com",
        "Wells Fargo", "Citi Double Cash")]), (k + 1).cast("int"))
    closing = F.concat(F.lit("Closing Date "), F.date_format(F.lit("2005-06-30").cast("date"),
                                                             "MM/dd/yyyy"))
    content = F.concat_ws(
        "\n", sign, closing, F.lit("01/01 01/01 ABCDEFGHIJK OUTSIDE $9.99"),
        F.when(entry.isNotNull(), F.lit("TRANSACTIONS")),
        F.when(entry.isNotNull(), F.lit("Trans. Post")), F.when(k == 1, F.lit("750")),
        entry, F.when(k == 1, F.lit("Bonus from Citi 12")), F.lit(""),
        F.when(entry.isNotNull(), F.lit("TOTAL FEES 0.00")),
        F.lit("02/02 02/02 ABCDEFGHIJK AFTER 9.99"),
    )
    return rows.select(F.col("id").alias("file_id"),
                       F.concat(F.lit("card_"), F.col("id").cast("string"), F.lit(".pdf"))
                       .alias("filename"), content.alias("content"))


WHAT = "regexp_replace(description, '\\s+', ' ', 'g')"
CARD_TYPE = "CASE WHEN transaction_type = 'CREDIT' THEN 'CREDIT' ELSE 'DEBIT' END"


def card_sql(kinds, confidence):
    """Expected rows of the given kinds; dates take the year of the billing period."""
    return f"""rows AS (SELECT id, TRY_CAST(concat_ws('-',
    CASE WHEN month(date) > 6 THEN 2004 ELSE 2005 END, month(date), day(date)) AS DATE) AS date,
  {WHAT} AS what, amount, transaction_type FROM ledger WHERE id % 6 = {kinds}),
m AS (SELECT *, {sql.line_merchant('what')} AS merchant_name FROM rows)
SELECT id AS file_id, date, what AS description, CAST(amount AS DOUBLE) AS amount,
  {CARD_TYPE} AS transaction_type, merchant_name,
  {sql.contains_case("lower(merchant_name || ' ' || what)", fv.LINE_CATEGORIES, "'Other'")}
    AS category, CAST({confidence} AS DOUBLE) AS confidence_score FROM m"""


CARD_OUT = ["file_id", "date", "description", "amount", "transaction_type", "merchant_name",
            "category", "confidence_score"]


def one_issuer(issuer):
    """Rows of one issuer, out of the statements of all."""
    def run(spark, sf_dir):
        files = card_files(spark, sf_dir)
        info = st.card_issuers(files).select("file_id", "issuer", "closing_month", "closing_year")
        section = st.card_section(text_source.to_lines(files)).join(info, "file_id")
        rows = st.card_lines(section).filter(F.col("bank_name") == issuer)
        return money_out(rows.select(*CARD_OUT))
    return run


for _i, (_name, _issuer, _score) in enumerate([
        ("t06_robinhood", "robinhood", 0.95), ("t07_citi", "citi", 0.97),
        ("t08_bofa", "bofa", 0.96), ("t09_capital_one", "capital_one", 0.96)]):
    add(_name, one_issuer(_issuer), f"WITH {card_sql(_i, _score)}", "ledger")


def dispatched(spark, sf_dir):
    files = card_files(spark, sf_dir)
    rows = st.card_statements(files, text_source.to_lines(files))
    return rows.groupBy("bank_name", "transaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


CREDIT_HIT = " OR ".join(f"contains(lower({WHAT}), {sql.quoted(w)})" for w in fv.CREDIT_WORDS)
DEBIT_HIT = " OR ".join(f"contains(lower({WHAT}), {sql.quoted(w)})" for w in fv.DEBIT_WORDS)
add("t10_issuer_dispatch", dispatched, f"""
SELECT ['robinhood', 'citi', 'bofa', 'capital_one', 'wells_fargo'][id % 6 + 1] AS bank_name,
  CASE WHEN id % 6 < 4 THEN {CARD_TYPE} WHEN {CREDIT_HIT} THEN 'CREDIT' WHEN {DEBIT_HIT}
    THEN 'DEBIT' ELSE 'UNKNOWN' END AS transaction_type, COUNT(*) AS n,
  CAST(SUM(amount) AS DOUBLE) AS amount FROM ledger WHERE id % 6 < 5 GROUP BY 1, 2""", "ledger")

add("f26_section_lines",
    lambda s, d: st.card_section(text_source.to_lines(card_files(s, d))).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_lines")),
    "SELECT id AS file_id, CAST(1 AS BIGINT) AS n_lines FROM ledger WHERE id % 6 < 5", "ledger")

add("f27_reward_bleed",
    lambda s, d: st.card_section(text_source.to_lines(card_files(s, d))).select(
        "file_id", "line").filter(F.col("line").contains("Eligible Purchases")), f"""
SELECT id AS file_id, concat_ws(' ', strftime(date, '%m/%d'),
  CASE WHEN id % 4 = 1 THEN strftime(date, '%m/%d') END, {WHAT},
  CASE WHEN transaction_type = 'CREDIT' THEN '-' ELSE '' END || '$'
    || format('{{:,.2f}}', CAST(amount AS DOUBLE)), 'Eligible Purchases: $750.49') AS line
FROM ledger WHERE id % 6 = 1""", "ledger")

# ------------------------------------------------------------ whole documents
add("s04_text_lines",
    lambda s, d: text_source.to_lines(statement_files(s, d)).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")), r"""
WITH l AS (SELECT file_id, trim(unnest(string_split_regex(content, '\r\n|\n|\r')),
  ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM statement_files)
SELECT file_id, COUNT(*) AS n_lines, CAST(SUM(length(line)) AS BIGINT) AS n_chars
FROM l WHERE line <> '' GROUP BY file_id""", "statement_files")


def paged(spark, sf_dir):
    """Documents with a legal page in the middle; names and texts of all formats."""
    docs = statement_files(spark, sf_dir)
    k = F.col("file_id") % 4
    legal = F.when(k == 1, F.lit("Arbitration Agreement\nDeposits")).when(
        k == 2, F.lit("*START*Transaction Detail BILLING RIGHTS")).otherwise("BILLING RIGHTS")
    name = F.when(k == 1, F.concat(F.lit("eStmt_"), "file_id")).when(
        k == 2, F.concat(F.lit("list_"), "file_id")).when(
        k == 3, F.concat(F.lit("other_"), "file_id")).otherwise(F.col("filename"))
    first = F.when(k == 2, F.lit("JPMorgan Chase\n")).otherwise(F.lit(""))
    return docs.select("file_id", name.alias("filename"), F.concat(
        first, F.replace("content", F.lit("\f"), F.lit(" ")), F.lit("\f"), legal, F.lit("\f"),
        F.lit("last page")).alias("content"), F.length("content").alias("n"))


add("s05_legal_pages",
    lambda s, d: text_source.with_format(paged(s, d)).select(
        "file_id", (F.length("content") - F.col("n")).cast("int").alias("extra_chars")), """
SELECT file_id, CAST(CASE file_id % 4 WHEN 1 THEN 1 + length('Arbitration Agreement Deposits') + 1 + 9
  WHEN 2 THEN length('JPMorgan Chase ') + 1 + length('*START*Transaction Detail BILLING RIGHTS')
    + 1 + 9 ELSE 1 + 9 END AS INTEGER) AS extra_chars FROM statement_files""",
    "statement_files")

add("s10_bank_format",
    lambda s, d: text_source.with_format(paged(s, d)).select("file_id", "bank_fmt"), """
SELECT file_id, CASE file_id % 4 WHEN 1 THEN 'boa' WHEN 2 THEN 'chase' ELSE 'dcu' END AS bank_fmt
FROM statement_files""", "statement_files")

add("w02_ordinal_in_key",
    lambda s, d: windows.number_within(ledger(s, d).select("id", "description"), ["description"],
                                       "id", width=5000), """
SELECT id, description, row_number() OVER (PARTITION BY description ORDER BY id) AS ordinal
FROM ledger""", "ledger")
