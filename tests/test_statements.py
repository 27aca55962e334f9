"""Statement lines -> rows, case by case."""

import datetime

from pyspark.sql import functions as F

from pennywright.operators import statements as st
from pennywright.plans.ingest import ingest_files
from pennywright.sources import statement_text as source

D = datetime.date
HEAD = ["01-01-25 to 01-31-25"]
CHECKING, SAVINGS = ["FREE CHECKING ACCT# 2"], ["PRIMARY SAVINGS ACCT# 1"]


def lines(spark, texts):
    rows = [(1, i, t.strip()) for i, t in enumerate(texts) if t.strip()]
    return spark.createDataFrame(rows, "file_id long, line_no long, line string")


def got(df, *columns):
    return [tuple(float(v) if k in ("amount", "balance") and v is not None else v
                  for k, v in zip(columns, (r[c] for c in columns)))
            for r in df.orderBy("line_no").collect()]


def test_savings(spark):
    frame = lines(spark, HEAD + SAVINGS + [
        "PREVIOUS BALANCE 5,000.00", "JAN02 TRANSFER FROM CHECKING 450.00 5,500.00",
        "JAN31 DIVIDEND 2.15 5,502.15", "NEW BALANCE 5,502.15"])
    assert got(st.dcu_savings(frame), "date", "description", "amount", "transaction_type",
               "balance") == [
        (D(2025, 1, 2), "TRANSFER FROM CHECKING", 450.0, "CREDIT", 5500.0),
        (D(2025, 1, 31), "DIVIDEND 2.15", 2.15, "CREDIT", 5502.15)]


def test_amount_inside_the_balance_stays_in_the_text(spark):
    frame = lines(spark, HEAD + SAVINGS + ["JAN02 TRANSFER FROM CHECKING 500.00 5,500.00"])
    assert got(st.dcu_savings(frame), "description") == [("TRANSFER FROM CHECKING 500.00",)]


def test_checking(spark):
    frame = lines(spark, HEAD + CHECKING + [
        "JAN05 STOP & SHOP -85.40 1,200.00",
        "JAN10 ACH DEBIT EVERSOURCE -145.00 1,055.00", "ENERGY ELECTRIC BILL",
        "JAN03 2,644.58 JAN17 2,692.55", "SECOND PART",
        "DEPOSITS, DIVIDENDS", "NOT PART OF IT",
        "JAN12 PAYROLL DIRECT DEP 2,400.00 3,600.00", "JAN13 ONLY ONE 5.00", "LOST",
        "BILLING RIGHTS SUMMARY", "JAN20 LEGAL 1.00 2.00"])
    assert got(st.dcu_checking(frame), "date", "description", "amount", "transaction_type") == [
        (D(2025, 1, 5), "STOP & SHOP", 85.4, "DEBIT"),
        (D(2025, 1, 10), "ACH DEBIT EVERSOURCE | ENERGY ELECTRIC BILL SECOND PART", 145.0,
         "DEBIT"),
        (D(2025, 1, 12), "PAYROLL DIRECT DEP", 2400.0, "CREDIT")]


def test_loan(spark):
    frame = lines(spark, HEAD + [
        "NEW VEHICLE LOAN# 142 PREVIOUS BALANCE 19,000.00", "INTEREST RATE DETAIL",
        "JAN15 LOAN PAYMENT 450.00 -320.00 18,680.00"])
    row = st.dcu_loan(frame).first()
    assert row.loan_identifier == "NEW VEHICLE LOAN# 142" and row.description == "LOAN PAYMENT"
    assert [float(row[c]) for c in ("payment_amount", "principal_amount", "interest_amount",
                                    "balance")] == [450.0, 320.0, 130.0, 18680.0]


def test_cross_year_period(spark):
    frame = lines(spark, ["12-01-24 to 01-31-25"] + CHECKING + [
        "DEC31 A -1.00 2.00", "JAN03 B -1.00 2.00"])
    assert got(st.dcu_checking(frame), "date") == [(D(2024, 12, 31),), (D(2025, 1, 3),)]


def test_boa(spark):
    frame = lines(spark, [
        "for March 7, 2026 to April 7, 2026", "Deposits and other additions",
        "03/19/26 PAYROLL 2,400.00", "ID:1 Account # 4870", "ID:2",
        "Deposits and other additions - continued", "Total deposits 1.00", "STRAY",
        "Other subtractions", "03/20/26 RENT -900.00 1,500.00", "03/21/26 no money",
        "Checks", "03/22/26 1234 -50.00", "not a continuation"])
    assert got(st.boa(frame), "date", "description", "amount", "transaction_type", "balance") == [
        (D(2026, 3, 19), "PAYROLL | ID:2 Deposits and other additions - continued", 2400.0,
         "CREDIT", None),
        (D(2026, 3, 20), "RENT", 900.0, "DEBIT", 1500.0),
        (D(2026, 3, 22), "Check #1234", 50.0, "DEBIT", None)]
    assert st.periods(frame, "boa").first().period_end == D(2026, 4, 7)


def test_chase(spark):
    frame = lines(spark, [
        "December 14, 2025throughJanuary 11, 2026", "01/02 OUTSIDE 1.00 2.00",
        "*start*transaction detail", "DATE  DESCRIPTION",
        "12/20 12/21 Card Purchase Transaction#: -20.00 1,020.00", "Line two", "Line three",
        "December 14, 2025throughJanuary 11, 2026", "Line four",
        "01/03 Deposit 5.00 1,025.00", "Page 2", "stray", "*end*transaction detail", "after"])
    assert got(st.chase(frame), "date", "description", "amount", "transaction_type", "balance") == [
        (D(2025, 12, 20), "Card Purchase | Line two | Line three | Line four", 20.0, "DEBIT",
         1020.0),
        (D(2026, 1, 3), "Deposit", 5.0, "CREDIT", 1025.0)]


def card(spark, content, filename="x.pdf"):
    files = spark.createDataFrame([(1, filename, content)],
                                  "file_id long, filename string, content string")
    return st.card_statements(files, source.to_lines(files), ["ANN EXAMPLE"])


def test_card_statement_formats(spark):
    citi = card(spark, "\n".join([
        "citicards.com", "Billing Period: 11/19/25-12/16/25", "01/01 BEFORE $1.00",
        "TRANSACTIONS", "ANN EXAMPLE #1", "01/26 01/26 SAMSCLUB #4969 $53.69 Eligible: $750.49",
        "12", "12/02 PAYMENT -$50.22", "TOTAL FEES", "12/03 AFTER $1.00"]))
    assert got(citi, "date", "description", "amount", "transaction_type", "merchant_name") == [
        (D(2025, 1, 26), "SAMSCLUB #4969", 53.69, "DEBIT", "Sam's Club"),
        (D(2025, 12, 2), "PAYMENT", 50.22, "CREDIT", "Payment")]
    one = card(spark, "\n".join([
        "capitalone.com", "Dec 6 - Jan 5, 2026", "Transactions",
        "Dec 8 Dec 9 SHELL OIL $1,142.30", "Jan 2 Jan 3 REFUND - $65.60"]))
    assert got(one, "date", "amount", "transaction_type") == [
        (D(2025, 12, 8), 1142.3, "DEBIT"), (D(2026, 1, 2), 65.6, "CREDIT")]


def test_unknown_card_uses_the_whole_text(spark):
    rows = card(spark, "some bank\n2024-03-01 REFUND -$12.50\n03/02/2024 PAYROLL DEPOSIT $3000.00")
    assert got(rows, "date", "amount", "transaction_type") == [
        (D(2024, 3, 1), 12.5, "DEBIT"), (D(2024, 3, 2), 300.0, "CREDIT")]
    assert card(spark, "Robinhood Card\n2024-03-01 LIMIT $12.50").count() == 0


def test_files_to_rows(spark, tmp_path):
    text = "\n".join(HEAD + SAVINGS + ["JAN31 DIVIDEND 2.15 5,502.15"])
    tmp_path = tmp_path / "in"
    tmp_path.mkdir()
    (tmp_path / "stmt_1.txt").write_text(text)
    (tmp_path / "stmt_copy.txt").write_text(text)
    (tmp_path / "eStmt_2.txt").write_text("Other subtractions\n03/20/26 RENT 900.00")
    (tmp_path / "list.txt").write_text(
        "JPMorgan Chase\nMay 1, 2026throughMay 31, 2026\n*start*transaction detail\n"
        "05/02 Fee -1.00 9.00\n*end*transaction detail")
    files = source.read_text(spark, str(tmp_path))
    registry = spark.createDataFrame([(10, "none")], "id long, file_hash string")
    out = ingest_files(files, registry)
    found = {r.bank_name: r for r in out.statements.collect()}
    assert {b: r.total_transactions for b, r in found.items()} == {"dcu": 1, "boa": 1, "chase": 1}
    assert sorted(r.id for r in found.values()) == [11, 12, 13]
    rows = {r.bank_name: r.statement_id for r in out.bank_rows.collect()}
    assert rows == {b: r.id for b, r in found.items()}
    registry = out.statements.select("id", "file_hash")
    assert ingest_files(files, registry).statements.count() == 0


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("CAFÉ".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("CAFÉ".encode("latin-1"))
    texts = source.read_text(spark, str(tmp_path)).select("content").collect()
    assert [t.content for t in texts] == ["CAFÉ", "CAFÉ"]


def test_card_lines_are_marked_once(spark):
    rows = card(spark, "some bank\n2024-03-01 REFUND -$12.50")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Window" not in plan  # they are read from where they were written


def test_period_of_a_span_needs_its_end(spark):
    from pennywright.functions.dates import billing_period
    texts = ["Dec 6, 2025 - Jan 5, 2026", "Closing Date: March 7 2024", "May to June 1 2 24, closing date 5/6/2023",
             "July 4", "from Nov 2 to DECEMBER, 31,2024"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select(
        "i", billing_period(F.col("t"), F.lit("x.pdf")).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in rows] == [(1, 2026), (3, 2024), (5, 2023), (None, 2025), (12, 2024)]
