"""Cleaning, matching, dates, amounts and line extraction over the ledger."""

from pyspark.sql import functions as F

from checks import rules_sql as sql
from checks.catalog import add
from checks.ledger_queries import MONTH, money_out
from checks.views import card_feed, ledger, table, loan
from pennywright.functions import dates, fixed_values as fv, money, text
from pennywright.functions.fuzzy import with_best_alias
from pennywright.operators import enrich, extract


def named(spark, sf_dir):
    """Ledger descriptions joined with merchant names: letters, marks, digits."""
    rows = ledger(spark, sf_dir)
    both = F.concat_ws(" #", F.col("description"), F.col("merchant_name"))
    return rows.select("id", "date", "amount", "description", "transaction_type",
                       "category", F.when(F.col("id") % 2 == 0, F.lower(both)).otherwise(both)
                       .alias("label"))


NAMED = """named AS (SELECT id, date, amount, description, transaction_type, category,
  CASE WHEN id % 2 = 0 THEN lower(concat_ws(' #', description, merchant_name))
  ELSE concat_ws(' #', description, merchant_name) END AS label FROM ledger)"""


def over_named(name, columns, query: str):
    """Compare columns(label) row by row; columns are made when a session is there."""
    add(name, lambda s, d: named(s, d).select(
        "id", *[c.alias(n) for n, c in columns(F.col("label")).items()]),
        f"WITH {NAMED} SELECT id, {query} FROM named", "ledger")


over_named("f01_clean_card", lambda label: {"cleaned": text.clean_card(label)},
           f"{sql.clean_card('label')} AS cleaned")
over_named("f02_clean_bank", lambda label: {"cleaned": text.clean_bank(label)},
           f"{sql.clean_bank('label')} AS cleaned")
over_named("f03_title_case", lambda label: {"title": text.title_case(F.concat(label, F.lit(" AT&T O'REILLY")))},
           sql.title("label || ' AT&T O''REILLY'") + " AS title")


def lined(spark, sf_dir):
    return text.with_line_merchant(named(spark, sf_dir).select("id", "label"), "label")


def banked(spark, sf_dir):
    return text.with_bank_category(named(spark, sf_dir).select("id", "label"), "label").select(
        "id", F.col("category").alias("bank_category"),
        text.bank_confidence(F.col("category")).alias("confidence"))


add("f04_line_merchant",
    lambda s, d: lined(s, d).select("id", F.col("merchant_name").alias("merchant")),
    f"WITH {NAMED} SELECT id, {sql.line_merchant('label')} AS merchant FROM named", "ledger")
add("f05_line_category",
    lambda s, d: lined(s, d).select("id", F.col("category").alias("line_category")),
    f"WITH {NAMED}, m AS (SELECT id, label, {sql.line_merchant('label')} AS merchant FROM named) "
    "SELECT id, " + sql.contains_case("lower(merchant || ' ' || label)", fv.LINE_CATEGORIES,
                                      "'Other'") + " AS line_category FROM m", "ledger")
BANK_CASE = sql.contains_case("upper(label)", fv.BANK_CATEGORIES, "'Uncategorized'")
add("f06_bank_category", banked, f"""
WITH {NAMED} SELECT id, {BANK_CASE} AS bank_category, CAST(CASE WHEN ({BANK_CASE}) = 'Uncategorized'
  THEN 0.3 ELSE 1.0 END AS DOUBLE) AS confidence FROM named""", "ledger")
add("f07_method_label",
    lambda s, d: banked(s, d).select("id", text.method_label(F.col("confidence")).alias("method")),
    f"""
WITH {NAMED} SELECT id, CASE WHEN ({BANK_CASE}) = 'Uncategorized' THEN 'fallback'
  ELSE 'rule_based' END AS method FROM named""", "ledger")
over_named("f28_anomaly_flags",
           lambda label: {"flags": F.array_join(text.anomaly_flags(F.col("amount"), F.col("category")), ",")},
           "concat_ws(',', CASE WHEN abs(amount) > 300 THEN 'large_transaction' END, "
           "CASE WHEN category = 'Uncategorized' THEN 'needs_review' END) AS flags")
over_named("f38_contains_ignoring_case", lambda label: {"hit": text.holds(label, "CHANT 1")},
           "label ILIKE '%CHANT 1%' AS hit")
over_named("f36_month_keys",
           lambda label: {"month": dates.month_key(F.col("date")), "year": dates.year_key(F.col("date")),
            "in_month": dates.in_month(F.col("date"), "1999-06-15")},
           f"{MONTH} AS month, strftime(date, '%Y') AS year, "
           "strftime(date, '%Y-%m') = '1999-06' AS in_month")
over_named("f37_day_distance",
           lambda label: {"days": dates.day_distance(F.lit("1995-01-01").cast("date"), F.col("date"))},
           "CAST(date_diff('day', DATE '1995-01-01', date) AS INTEGER) AS days")
over_named("f30_merchant_hint", lambda label: {"hint": text.merchant_hint(F.col("description"))},
           """array_to_string(list_filter(list_transform(string_split_regex(trim(description),
  '\\s+'), lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')),
  lambda w: length(w) > 1 AND NOT regexp_matches(w, '^\\d{4,}$|^\\d{3}-\\d{3}-\\d{4}$|^[A-Z]{2}$')
  )[1:3], ' ') AS hint""")
over_named("f31_location", lambda label: {"location": text.location(F.col("description"))},
           """NULLIF(concat_ws(', ', NULLIF(regexp_extract(CASE
    WHEN contains(description, 'SEATTLE') THEN 'Seattle'
    WHEN contains(description, 'AUSTIN') THEN 'Austin'
    WHEN contains(description, 'HOUSTON') THEN 'Houston'
    WHEN contains(description, 'RICHMOND') THEN 'Richmond'
    WHEN contains(description, 'NYC') THEN 'Nyc' ELSE '' END, '.*'), ''),
  NULLIF(regexp_extract(description, ' (WA|TX|CA|VA)$', 1), '')), '') AS location""")

# ------------------------------------------------------------ amounts and types
PRINTED = """printed AS (SELECT id, date, amount, transaction_type, description,
  CAST(amount AS VARCHAR) AS plain FROM ledger)"""


def printed(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        "id", "date", "amount", "transaction_type", "description",
        F.col("amount").cast("string").alias("plain"))


def shown_amount(row_key="id"):
    """The same amount printed six ways, by row."""
    k, plain = F.col(row_key) % 6, F.col("plain")
    grouped = F.format_number("amount", 2)
    return (
        F.when(k == 0, plain).when(k == 1, F.concat(F.lit("-$"), grouped))
        .when(k == 2, F.concat(F.lit("($"), grouped, F.lit(")")))
        .when(k == 3, F.concat(F.lit("$ "), grouped)).when(k == 4, F.lit("nan"))
        .otherwise(F.lit("n/a"))
    )


add("f08_parse_amount",
    lambda s, d: printed(s, d).select(
        "id", money.dollars(money.parse_amount(shown_amount(), csv=True)).alias("value")),
    """SELECT id, CASE WHEN id % 6 IN (0, 3) THEN CAST(amount AS DOUBLE)
  WHEN id % 6 IN (1, 2) THEN -CAST(amount AS DOUBLE) END AS value FROM ledger""", "ledger")

add("f12_line_type",
    lambda s, d: named(s, d).select(
        "id", money.line_type(F.concat_ws(" ", "label", F.when(F.col("id") % 5 == 0, "(25.00)")),
                              F.when(F.col("id") % 7 == 0, -1).otherwise(1)).alias("kind")),
    f"""WITH {NAMED} SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'DEBIT'
  WHEN {' OR '.join(f"contains(lower(label), {sql.quoted(w)})" for w in fv.CREDIT_WORDS)}
    THEN 'CREDIT'
  WHEN {' OR '.join(f"contains(lower(label), {sql.quoted(w)})" for w in fv.DEBIT_WORDS)}
    THEN 'DEBIT' ELSE 'UNKNOWN' END AS kind FROM named""", "ledger")

add("f13_row_type",
    lambda s, d: named(s, d).select(
        "id", money.row_type(F.lower("transaction_type"), F.col("label")).alias("kind")),
    f"""WITH {NAMED} SELECT id, CASE WHEN transaction_type IN ('DEBIT', 'CREDIT')
    THEN transaction_type
  WHEN {' OR '.join(f"contains(lower(label), {sql.quoted(w)})" for w in fv.CREDIT_WORDS)}
    THEN 'CREDIT' ELSE 'DEBIT' END AS kind FROM named""", "ledger")


def csv_amounts(spark, sf_dir):
    k, plain = F.col("id") % 7, F.col("plain")
    debit = F.when(k == 0, plain).when(k == 1, "0.00").when(k == 2, "-")
    credit = F.when(k.isin(0, 1), plain).when(k == 2, "")
    single = F.when(k == 3, F.concat(F.lit("-"), plain)).when(k >= 2, plain)
    kind = F.when(k == 4, "credit").when(k == 5, "ach credit").when(k == 6, "sale")
    parts = money.csv_amount(debit, credit, single, kind)
    return printed(spark, sf_dir).select("id", parts.alias("p")).select(
        "id", money.dollars(F.col("p.amount")).alias("amount"), "p.transaction_type")


add("f18_csv_amount", csv_amounts, """
SELECT id, CASE WHEN id % 7 = 3 THEN -CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) END
    AS amount,
  CASE WHEN id % 7 IN (1, 4, 5) THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type
FROM ledger""", "ledger")

add("f33_loan_interest",
    lambda s, d: loan(s, d).select(
        "l_orderkey", "payment_amount",
        money.loan_interest(F.col("payment_amount"), -F.col("principal_amount"))
        .alias("interest")).transform(lambda x: money_out(x, "payment_amount", "interest")),
    """SELECT l_orderkey, CAST(payment_amount AS DOUBLE) AS payment_amount,
  CAST(greatest(payment_amount - principal_amount, 0) AS DOUBLE) AS interest FROM loan""",
    "loan")

add("f34_signed_type",
    lambda s, d: card_feed(s, d).select(
        "transaction_id",
        money.signed_type(F.when(F.col("transaction_id") % 3 == 0, 0).otherwise(F.col("amount")),
                          F.concat_ws(" | ", F.when(F.col("pending"), "ach credit").otherwise(
                              F.lit("check")), F.lit("DEPOSIT"))).alias("kind")),
    """SELECT transaction_id, CASE WHEN transaction_id % 3 = 0 THEN
    CASE WHEN pending THEN 'CREDIT' ELSE 'DEBIT' END
  WHEN amount > 0 THEN 'CREDIT' WHEN amount < 0 THEN 'DEBIT'
  WHEN pending THEN 'CREDIT' ELSE 'DEBIT' END AS kind FROM card_feed""", "card_feed")

# ------------------------------------------------------------ dates
FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yy", "MM-dd-yyyy", "MMM d, yyyy", "MMMM d yyyy",
           "yyyyMMdd"]


def shown_date():
    case = None
    for i, fmt in enumerate(FORMATS):
        test = F.col("id") % 9 == i
        value = F.date_format("date", fmt)
        case = F.when(test, value) if case is None else case.when(test, value)
    return case.when(F.col("id") % 9 == 7, "13/45/1999").otherwise(F.lit("soon"))


add("f10_parse_date",
    lambda s, d: ledger(s, d).select(
        "id", shown_date().alias("shown")).select(
        "id", dates.parse_date(F.col("shown")).alias("parsed")),
    "SELECT id, CASE WHEN id % 9 < 7 THEN CASE WHEN id % 9 = 2 AND year(date) < 1970 THEN NULL "
    "ELSE date END END AS parsed FROM ledger", "ledger")

add("f09_first_date_and_amount",
    lambda s, d: extract.line_fields(statement_lines(s, d)).select(
        "id", "date_text", money.dollars(F.col("amount")).alias("amount")),
    """SELECT id, strftime(date, '%m/%d/%Y') AS date_text,
  CASE WHEN id % 2 = 0 THEN CAST(amount AS DOUBLE) ELSE -CAST(amount AS DOUBLE) END AS amount
FROM ledger""", "ledger")


def statement_lines(spark, sf_dir):
    """One printed line per ledger row: date, description, amount (odd rows negative)."""
    shown = F.concat(F.when(F.col("id") % 2 == 1, "-").otherwise(F.lit("")), F.lit("$"),
                     F.format_number("amount", 2))
    return ledger(spark, sf_dir).select(
        "id", "date",
        F.concat_ws("  ", F.date_format("date", "MM/dd/yyyy"),
                    F.when(F.col("id") % 12 != 4, F.col("description")).otherwise("NETFLIX"),
                    shown).alias("line"))


ZONE = "CASE WHEN id % 12 <> 4 THEN description ELSE 'NETFLIX' END"
GROUPED = "format('{:,.2f}', CAST(amount AS DOUBLE))"
SIGN = "CASE WHEN id % 2 = 1 THEN '-' ELSE '' END"
# what str(float) prints: no trailing zero beyond the first decimal
AS_FLOAT = "regexp_replace(CAST(amount AS VARCHAR), '0$', '')"
LINE_DESC = (f"trim(regexp_replace(regexp_replace(replace(replace('  ' || {ZONE} || '  ' || {SIGN}"
             f" || '$' || {GROUPED}, strftime(date, '%m/%d/%Y'), ''), {SIGN} || {AS_FLOAT}, ''),"
             " '[$()]', '', 'g'), '\\s+', ' ', 'g'))")

add("f11_line_description",
    lambda s, d: extract.line_fields(statement_lines(s, d)).select("id", "description"),
    f"SELECT id, {LINE_DESC} AS description FROM ledger", "ledger")

add("f14_line_confidence",
    lambda s, d: extract.line_transactions(statement_lines(s, d)).select(
        "id", "confidence_score"),
    "SELECT id, CAST(1.0 AS DOUBLE) AS confidence_score FROM ledger", "ledger")


def headed_lines(spark, sf_dir):
    """Printed lines with every eighth one turned into a column header or a total."""
    head = F.when(F.col("id") % 16 == 0, "Date Description Amount").otherwise(
        F.concat(F.lit("Closing balance "), F.col("id").cast("string")))
    return statement_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("id") % 8 == 0, head).otherwise(F.col("line")))


add("f15_header_lines",
    lambda s, d: headed_lines(s, d).filter(~text.is_header_line(F.col("line"))).select("id"),
    "SELECT id FROM ledger WHERE id % 8 <> 0", "ledger")

CREDIT_LINE = " OR ".join(
    f"contains(lower({ZONE}), {sql.quoted(w)})" for w in fv.CREDIT_WORDS)
DEBIT_LINE = " OR ".join(
    f"contains(lower({ZONE}), {sql.quoted(w)})" for w in fv.DEBIT_WORDS)
add("f16_line_transactions",
    lambda s, d: money_out(extract.line_transactions(headed_lines(s, d)).select(
        "id", F.col("parsed_date").alias("date"), "description", "amount", "transaction_type",
        "merchant_name", "category")),
    f"""WITH lines AS (SELECT id, date, amount, {LINE_DESC} AS description,
  CASE WHEN id % 2 = 1 THEN 'DEBIT' WHEN {CREDIT_LINE} THEN 'CREDIT' WHEN {DEBIT_LINE}
    THEN 'DEBIT' ELSE 'UNKNOWN' END AS transaction_type FROM ledger WHERE id % 8 <> 0),
merchants AS (SELECT *, {sql.line_merchant('description')} AS merchant_name FROM lines)
SELECT id, date, description, CAST(amount AS DOUBLE) AS amount, transaction_type, merchant_name,
  {sql.contains_case("lower(merchant_name || ' ' || description)", fv.LINE_CATEGORIES,
                     "'Other'")} AS category FROM merchants""", "ledger")


def structured(spark, sf_dir):
    rows = printed(spark, sf_dir).select(
        "id", F.date_format("date", "MM/dd/yyyy").alias("date"),
        "description", shown_amount().alias("amount"),
        F.lower("transaction_type").alias("type"), F.lit("").alias("balance"))
    return money_out(extract.structured_transactions(rows).select(
        "id", "date", "description", "amount", "transaction_type", "merchant_name"))


add("f17_structured_rows", structured, f"""
SELECT id, date, trim(description) AS description,
  CASE WHEN id % 6 IN (0, 3) THEN CAST(amount AS DOUBLE) ELSE -CAST(amount AS DOUBLE) END
    AS amount,
  CASE WHEN transaction_type IN ('DEBIT', 'CREDIT') THEN transaction_type
    WHEN {' OR '.join(f"contains(lower(description), {sql.quoted(w)})" for w in fv.CREDIT_WORDS)}
    THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
  {sql.line_merchant('trim(description)')} AS merchant_name
FROM ledger WHERE id % 6 < 4""", "ledger")

START, END = (lambda: F.add_months(F.trunc("date", "MM"), -1)), (lambda: F.last_day("date"))
add("f19_month_day_date",
    lambda s, d: ledger(s, d).select("id", dates.month_day_date(
        F.upper(F.date_format("date", "MMMdd")), START(), END()).alias("parsed")),
    "SELECT id, date AS parsed FROM ledger", "ledger")
add("f20_period_date",
    lambda s, d: ledger(s, d).select(
        "id", dates.period_date(F.date_format("date", "MM-dd-yy")).alias("parsed")),
    "SELECT id, date AS parsed FROM ledger", "ledger")
add("f21_short_and_long_dates",
    lambda s, d: ledger(s, d).select(
        "id", dates.period_date(F.date_format("date", "MM/dd/yy")).alias("short"),
        dates.long_date(F.date_format("date", "MMMM d, yyyy")).alias("long")),
    "SELECT id, date AS short, date AS long FROM ledger", "ledger")
add("f22_slash_date",
    lambda s, d: ledger(s, d).select("id", dates.slash_date(
        F.date_format("date", "MM/dd"), START(), END()).alias("parsed")),
    "SELECT id, date AS parsed FROM ledger", "ledger")


def periods(spark, sf_dir):
    k = F.col("id") % 8
    when = F.col("date")
    words = (
        F.when(k == 0, F.concat(F.lit("August 6 - "), F.date_format(when, "MMMM d, yyyy")))
        .when(k == 1, F.concat(F.lit("StatementClosingDate "),
                               F.date_format(when, "MMMMdd,yyyy")))
        .when(k == 2, F.concat(F.lit("Statement Closing Date "),
                               F.date_format(when, "MM/dd/yyyy")))
        .when(k == 6, F.concat(F.lit("P.O. Box 75267-2050 code "),
                               F.date_format(when, "M/d/"), F.lit("26")))
        .otherwise("no year in text")
    )
    name = (
        F.when(k == 3, F.concat(F.lit("eStmt_"), F.date_format(F.lit("2026-01-05").cast("date"),
                                                              "yyyy-MM-dd"), F.lit(".pdf")))
        .when(k == 4, F.lit("January2026.pdf")).when(k == 5, F.lit("Credit_Statement_2026.pdf"))
        .otherwise("")
    )
    period = dates.billing_period(words, name)
    late = ledger(spark, sf_dir).withColumn("date", F.add_months("date", 120))
    return late.select("id", "date", period.alias("p")).select(
        "id", "p.closing_month", "p.closing_year",
        dates.year_for_month(F.month("date"), F.col("p.closing_month"),
                             F.col("p.closing_year")).alias("txn_year"))


PERIOD_SQL = """WITH late AS (SELECT id, CAST(date + INTERVAL 120 MONTH AS DATE) AS date
  FROM ledger),
p AS (SELECT id, date, CASE WHEN id % 8 IN (0, 1, 2) THEN month(date)
    WHEN id % 8 IN (3, 4) THEN 1 WHEN id % 8 = 5 THEN 12 END AS closing_month,
  CASE WHEN id % 8 IN (0, 1, 2) THEN year(date) WHEN id % 8 IN (3, 4, 5, 6) THEN 2026
    ELSE 2025 END AS closing_year FROM late)
SELECT id, CAST(closing_month AS INTEGER) AS closing_month,
  CAST(closing_year AS INTEGER) AS closing_year,
  CAST(CASE WHEN month(date) > closing_month THEN closing_year - 1 ELSE closing_year END
    AS INTEGER) AS txn_year FROM p"""
add("f23_billing_period",
    lambda s, d: periods(s, d).drop("txn_year"),
    f"SELECT id, closing_month, closing_year FROM ({PERIOD_SQL.replace('WITH late', 'WITH late')})",
    "ledger")
add("f24_year_for_month", lambda s, d: periods(s, d).select("id", "txn_year"),
    f"SELECT id, txn_year FROM ({PERIOD_SQL})", "ledger")

SIGNATURES = ["Robinhood Gold", "CitiCards.com", "Bank of America Visa", "capitalone.com",
              "JPMorgan", "Wells Fargo", "AMEX", "Discover Card", "U.S. Bank", "Barclays",
              "nothing known"]
NAMES = list(fv.BANK_SIGNATURES) + ["unknown"]


def issuers(spark, sf_dir):
    sign = F.element_at(F.array(*[F.lit(x) for x in SIGNATURES]),
                        (F.col("id") % 11 + 1).cast("int"))
    return ledger(spark, sf_dir).select(
        "id", text.card_issuer(F.concat_ws(" ", "description", sign)).alias("issuer"))


add("f25_card_issuer", issuers,
    f"SELECT id, CASE WHEN contains(lower(description), 'robinhood des') AND id % 11 = 0 THEN "
    f"'robinhood' WHEN id % 12 = 9 AND id % 11 > 4 THEN 'chase' "
    f"ELSE ([{', '.join(sql.quoted(n) for n in NAMES)}])[id % 11 + 1] END AS issuer FROM ledger",
    "ledger")

add("f39_timestamp_scrub",
    lambda s, d: card_feed(s, d).select(
        "transaction_id",
        F.concat(F.date_format("ts", "yyyy-MM-dd HH"), F.when(F.col("pending"), "uman")
                 .otherwise(F.lit("")), F.date_format("ts", ":mm:ss")).alias("raw"))
    .select("transaction_id", dates.clean_timestamp(F.col("raw")).cast("timestamp_ntz")
            .alias("fixed")),
    "SELECT transaction_id, date_trunc('second', ts) AS fixed FROM card_feed", "card_feed")


def renormalised(spark, sf_dir):
    k = F.col("id") % 5
    raw = (F.when(k == 0, F.date_format("date", "yyyy-MM-dd"))
           .when(k == 1, F.date_format("date", "MM/dd/yyyy"))
           .when(k == 2, F.date_format("date", "yyyyMMdd"))
           .when(k == 3, F.concat(F.lit("31/"), F.date_format("date", "MM/yyyy")))
           .otherwise("about then"))
    return ledger(spark, sf_dir).select("id", raw.alias("raw")).select(
        "id", dates.renormalise_date(F.col("raw")).alias("fixed"))


add("f40_renormalise_date", renormalised, """
SELECT id, CASE WHEN id % 5 < 3 THEN strftime(date, '%Y-%m-%d')
  WHEN id % 5 = 3 THEN CASE WHEN day(last_day(date)) = 31 THEN strftime(last_day(date), '%Y-%m-%d')
    ELSE '31/' || strftime(date, '%m/%Y') END
  ELSE 'about then' END AS fixed FROM ledger""", "ledger")

# ------------------------------------------------------------ enrichment
EXACT = f"exact AS (SELECT id, description, {sql.clean_card('description')} AS cleaned FROM ledger)"
FOUND = (f"found AS (SELECT *, {sql.contains_case('cleaned', sql.alias_groups())} AS merchant_name "
         "FROM exact)")


def exact_rows(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        "id", text.clean_card(F.col("description")).alias("cleaned")).withColumn(
        "merchant_name", enrich.exact_merchant(F.col("cleaned")))


add("j07_alias_contains", exact_rows,
    f"WITH {EXACT}, {FOUND} SELECT id, cleaned, merchant_name FROM found", "ledger")


def looked_up(spark, sf_dir):
    rows = exact_rows(spark, sf_dir).withColumn("merchant_score", F.lit(1.0))
    return enrich.categorise(rows).select("id", "merchant_name", "category", "subcategory",
                                          "confidence_score")


add("j06_merchant_category", looked_up, f"""
WITH {EXACT}, {FOUND}, taxonomy(merchant_name, category, subcategory) AS
  (VALUES {sql.taxonomy_values()})
SELECT f.id, f.merchant_name, COALESCE(t.category, 'Uncategorized') AS category,
  COALESCE(t.subcategory, 'Other') AS subcategory,
  CAST(CASE WHEN t.category IS NULL THEN 0.2 ELSE 1.0 END AS DOUBLE) AS confidence_score
FROM found f LEFT JOIN taxonomy t USING (merchant_name)""", "ledger")


NEAR_MISSES = sql.fuzzy_pairs()


def near_misses(spark, sf_dir):
    """Two misspelt alias texts per customer: a letter dropped, replaced or put in, in other words."""
    words = F.array(*[F.lit(a) for a, _ in NEAR_MISSES])
    rows = table(spark, sf_dir, "customer").select(F.explode(F.array(
        F.col("c_custkey") * 2, F.col("c_custkey") * 2 + 1)).alias("id"))
    rows = rows.withColumn("a", F.get(words, (F.col("id") % len(NEAR_MISSES)).cast("int")))
    rows = rows.withColumns({
        "p": ((F.expr(f"id div {len(NEAR_MISSES)}") + F.expr("id div 5")) % F.length("a") + 1).cast("int"),
        "x": F.chr(65 + F.expr("id div 7") % 26), "op": F.expr("id div 3") % 4})
    miss = F.concat(F.substring("a", F.lit(1), F.col("p") - 1),
                    F.when(F.col("op") == 0, F.lit("")).otherwise(F.col("x")),
                    F.expr("substring(a, p + IF(op = 2, 0, 1))"),
                    F.when(F.col("op") == 3, F.lit(" AG")).otherwise(F.lit("")))
    before = F.get(F.array(*[F.lit(w) for w in ("", "SQ ", "TST* ", "POS ")]), (F.col("id") % 4).cast("int"))
    after = F.get(F.array(*[F.lit(w) for w in ("", " STORE", " 10234", " NORTH AVE")]),
                  (F.expr("id div 4") % 4).cast("int"))
    return rows.select("id", F.concat(before, miss, after).alias("description"))


NEAR_MISSES_SQL = f"""misses AS (
  SELECT id, ['', 'SQ ', 'TST* ', 'POS '][id % 4 + 1] || a[1:p - 1] || CASE WHEN op = 0 THEN '' ELSE x END
    || a[p + CASE WHEN op = 2 THEN 0 ELSE 1 END:] || CASE WHEN op = 3 THEN ' AG' ELSE '' END
    || ['', ' STORE', ' 10234', ' NORTH AVE'][id // 4 % 4 + 1] AS description
  FROM (SELECT *, (id // {len(NEAR_MISSES)} + id // 5) % length(a) + 1 AS p, chr((65 + id // 7 % 26)::INTEGER) AS x,
               id // 3 % 4 AS op
        FROM (SELECT id, ([{', '.join(sql.quoted(a) for a, _ in NEAR_MISSES)}])[id % {len(NEAR_MISSES)} + 1] AS a
              FROM (SELECT unnest([c_custkey * 2, c_custkey * 2 + 1]) AS id FROM customer))))"""


def fuzzy_scores(spark, sf_dir):
    """Distinct cleaned texts no fragment matched, with their best alias."""
    cleaned = near_misses(spark, sf_dir).select(text.clean_card(F.col("description")).alias("cleaned"))
    rest = cleaned.filter(enrich.exact_merchant(F.col("cleaned")).isNull()).groupBy("cleaned").agg(
        F.count(F.lit(1)).alias("n_rows"))
    scored = with_best_alias(rest, "cleaned", "m", [a for a, _ in NEAR_MISSES])
    names = F.array(*[F.lit(n) for _, n in NEAR_MISSES])
    return scored.select("cleaned", "n_rows", F.get(names, F.col("m.position")).alias("name"),
                         F.col("m.score").alias("score"))


add("j08_fuzzy_match", fuzzy_scores, f"""
WITH {NEAR_MISSES_SQL}, cleaned AS (SELECT {sql.clean_card('description')} AS cleaned FROM misses),
known AS (SELECT cleaned AS s, count(*) AS n_rows FROM cleaned
          WHERE ({sql.contains_case('cleaned', sql.alias_groups())}) IS NULL GROUP BY cleaned),
{sql.best_aliases('known', 'best')}
SELECT s AS cleaned, n_rows, name, score FROM known LEFT JOIN best USING (s)""")


def resolved(rows):
    return enrich.resolve_merchants(rows).select(
        "id", "cleaned", "merchant_name", "merchant_score", "method")


RESOLVED = "SELECT id, cleaned, merchant_name, merchant_score, method FROM resolved"

add("f29_merchant_resolution", lambda s, d: resolved(ledger(s, d).select("id", "description")),
    f"WITH {sql.resolved_merchants('ledger')} {RESOLVED}", "ledger")

add("f29_near_misses", lambda s, d: resolved(near_misses(s, d)),
    f"WITH {NEAR_MISSES_SQL}, {sql.resolved_merchants('misses')} {RESOLVED}")

add("f29_enriched_card",
    lambda s, d: money_out(enrich.enrich_card(ledger(s, d))).withColumn(
        "flags", F.array_join("flags", ",")), f"""
WITH {sql.resolved_merchants('ledger')}, taxonomy(merchant_name, category, subcategory) AS
  (VALUES {sql.taxonomy_values()}),
placed AS (
  SELECT l.id AS raw_id, statement_id, bank_name, date, raw AS description, cleaned AS clean_description,
    amount, coalesce(l.transaction_type, 'UNKNOWN') AS transaction_type, balance, r.merchant_name,
    raw AS merchant_raw, coalesce(t.category, 'Uncategorized') AS category,
    coalesce(t.subcategory, 'Other') AS subcategory, {sql.location('raw')} AS location,
    CASE WHEN t.category IS NULL THEN 0.2::DOUBLE ELSE merchant_score END AS confidence_score,
    method AS enrichment_method
  FROM ledger l JOIN resolved r USING (id) LEFT JOIN taxonomy t ON t.merchant_name = r.merchant_name)
SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance),
  concat_ws(',', CASE WHEN abs(amount) > 300 THEN 'large_transaction' END,
            CASE WHEN category = 'Uncategorized' THEN 'needs_review' END) AS flags
FROM placed""", "ledger")

BANK = sql.contains_case("upper(description)", fv.BANK_CATEGORIES, "'Uncategorized'")
add("f06_enriched_bank",
    lambda s, d: money_out(enrich.enrich_bank(ledger(s, d))), f"""
SELECT raw_id, statement_id, bank_name, account_type, date, description,
  {sql.clean_bank('description')} AS clean_description, CAST(amount AS DOUBLE) AS amount,
  transaction_type, CAST(balance AS DOUBLE) AS balance, {BANK} AS category,
  CAST(CASE WHEN ({BANK}) = 'Uncategorized' THEN 0.3 ELSE 1.0 END AS DOUBLE) AS confidence_score,
  CASE WHEN ({BANK}) = 'Uncategorized' THEN 'fallback' ELSE 'rule_based' END
    AS enrichment_method FROM ledger""", "ledger")
