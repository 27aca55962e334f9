"""Named queries on the seed ledgers, and the driver contract."""

import datetime

import pytest
from pyspark.sql import functions as F

from pennywright.operators.free_sql import query
from pennywright.plans import bank, card, common, registry
from pennywright.sources.csv_statements import column_mapping

CARD = [
    (1, "capital_one", "2025-01-05", "STARBUCKS #1234", "8.50", "DEBIT", "Starbucks",
     "Food & Dining", "Coffee", 0.95),
    (2, "capital_one", "2025-01-10", "AMAZON.COM", "55.99", "DEBIT", "Amazon", "Shopping",
     "Online Retail", 0.90),
    (3, "capital_one", "2025-01-15", "PAYCHECK DIRECT DEP", "1200.00", "CREDIT", None, "Income",
     None, 0.80),
    (4, "capital_one", "2025-01-20", "NETFLIX", "15.99", "DEBIT", "Netflix", "Entertainment",
     "Streaming", 0.98),
    (5, "capital_one", "2025-01-20", "NETFLIX", "15.99", "DEBIT", "Netflix", "Entertainment",
     "Streaming", 0.98),
    (6, "citi", "2025-02-03", "WHOLE FOODS", "87.40", "DEBIT", "Whole Foods", "Groceries",
     "Supermarket", 0.92),
    (7, "citi", "2025-02-10", "UBER", "22.00", "DEBIT", "Uber", "Transportation", "Rideshare",
     0.88),
    (8, "citi", "2025-02-18", "MYSTERY CHARGE", "99.00", "DEBIT", None, "Uncategorized", None,
     0.10),
]


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(
        CARD, "id long, bank_name string, date string, description string, amount string, "
        "transaction_type string, merchant_name string, category string, subcategory string, "
        "confidence_score double").withColumns({
            "date": F.col("date").cast("date"), "amount": F.col("amount").cast("decimal(18,2)"),
            "account_type": F.when(F.col("id") < 4, "savings").otherwise("checking"),
            "balance": F.when(F.col("id") != 8, F.col("id") * 10).cast("decimal(18,2)")})


def test_card_queries(ledger):
    spent = {r.category: r.total_spent for r in card.categories(ledger).collect()}
    assert spent["Groceries"] == 87.4 and spent["Income"] == 0.0 and len(spent) == 7
    twice = card.duplicates(ledger).collect()
    assert [(r.merchant_name, r.occurrence_count, r.days_apart) for r in twice] == [
        ("Netflix", 2, 0)]
    months = [r.month for r in card.spending_by_month(ledger).collect()]
    assert months == ["2025-02", "2025-01"]
    names = [r.merchant_name for r in card.merchants(ledger, 500).collect()]
    assert names[0] == "Netflix" and None not in names
    assert [r.id for r in card.uncategorized(ledger).collect()] == [8]
    assert [r.id for r in card.find(ledger, merchant="net", transaction_type="debit").collect()] \
        == [4, 5]
    empty = card.spending_summary(ledger, month="1999-01").first()
    assert empty.transaction_count == 0 and empty.total_spent is None
    assert card.stats(ledger.limit(0)).first().total_debits == 0.0
    assert card.subcategory_summary(ledger.drop("subcategory")).count() == 0
    assert card.merchants(ledger).filter("merchant_name = 'Netflix'").first().avg_amount == 15.99


def test_bank_queries(ledger):
    latest = {r.account_type: (r.date, float(r.balance)) for r in bank.balances(ledger).collect()}
    assert latest == {"savings": (datetime.date(2025, 1, 15), 30.0),
                      "checking": (datetime.date(2025, 2, 10), 70.0)}
    rows = bank.by_category(ledger, "o", year="1999", month="2025-02").collect()
    assert {r.id for r in rows} == {6, 7, 8} and rows[0].clean_description is None
    assert bank.find(ledger, transaction_type="debit").count() == 0


def test_routing_and_registry(ledger):
    assert common.active_ledger(None, ledger) is ledger
    assert common.active_ledger(ledger.limit(0), ledger) is ledger
    assert registry.run("card.largest", ledger).first().id == 3
    with pytest.raises(KeyError):
        registry.run("card.no_such_query", ledger)


@pytest.mark.parametrize("sql", [
    "DELETE FROM ledger", "  drop table x", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
    "REPLACE TABLE x AS SELECT 1", ""])
def test_writes_are_refused(spark, ledger, sql):
    with pytest.raises(PermissionError):
        query(spark, sql, {"ledger": ledger})


def test_free_sql_binds_values(spark, ledger):
    found = query(spark, "SELECT id FROM ledger WHERE description = :d OR 'DROP' = ''",
                  {"ledger": ledger}, {"d": "x' OR '1'='1"})
    assert found.count() == 0


def test_csv_columns():
    assert column_mapping(["Trans Date ", "Payee", "Amount"]) == {
        "date": "Trans Date ", "description": "Payee", "amount": "Amount"}
    for bad in (["Payee", "Amount"], ["Date", "Payee"]):
        with pytest.raises(ValueError):
            column_mapping(bad)


def test_driver_contract(spark):
    import __spark_entry__ as driver
    assert driver.entry(spark).count() > 0
    queries, oracles = driver.queries(), driver.oracle_sql()
    assert set(oracles) <= set(queries)
    for name in ("a18_ledger_stats", "j04_latest_balance", "w02_ordinal_in_key"):
        assert queries[name](spark, "/root/testdata/sf0.001").count() > 0


def test_context_sends_no_frame_of_tickers_to_every_task(spark):
    from pennywright.plans import portfolio
    asked = spark.createDataFrame([("a ",), ("b",)], "ticker string")
    held = spark.createDataFrame([("A", 1.0, 1.0, 2.0, 2.0, 100.0)],
                                 "ticker string, quantity double, avg_cost double, current_price double, "
                                 "equity double, pct_change double")
    info = spark.createDataFrame([("A", "Alpha", "x"), ("B", "Beta", None)],
                                 "ticker string, company_name string, industry string")
    headlines = spark.createDataFrame([("x", "news of x", 1), ("B", "news of b", 1)],
                                      "topic string, headline string, place int")
    found = portfolio.context(asked, held, info, headlines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 4
    rows = {r.ticker: (r.held, r.company_name, r.company_news, r.industry_news) for r in found.collect()}
    assert rows == {"A": (True, "Alpha", [], ["news of x"]), "B": (False, "Beta", ["news of b"], [])}
