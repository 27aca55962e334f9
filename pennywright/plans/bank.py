"""Named queries over checking, savings and loan ledgers."""

from pyspark.sql import DataFrame, functions as F

from pennywright.functions import dates
from pennywright.functions.money import dollars, is_credit, is_debit, total
from pennywright.functions.text import holds
from pennywright.operators.windows import latest_rows
from pennywright.plans.common import (
    capped, has, newest_first, received, row_count, spent, where,
)
from pennywright.plans.registry import named


def _account(account_type):
    return F.col("account_type") == account_type if account_type else None


def _period(year, month):
    """Month beats year."""
    if month:
        return dates.in_month(F.col("date"), month)
    return dates.in_year(F.col("date"), year) if year else None


def _with_clean(ledger: DataFrame) -> DataFrame:
    """Raw ledgers have no cleaned description; show it as null."""
    if has(ledger, "clean_description"):
        return ledger
    return ledger.withColumn("clean_description", F.lit(None).cast("string"))


@named("bank.categories")
def categories(ledger: DataFrame, account_type: str = None) -> DataFrame:
    """By category; a null category is a group of its own."""
    return (
        where(ledger, _account(account_type))
        .groupBy("category")
        .agg(row_count(), spent(), received())
        .orderBy(F.desc("total_spent"), F.asc_nulls_first("category"))
    )


@named("bank.summary")
def summary(ledger: DataFrame, month=None, category=None, account_type=None) -> DataFrame:
    result = where(
        ledger,
        dates.in_month(F.col("date"), month) if month else None,
        holds(F.col("category"), category) if category else None,
        _account(account_type),
    ).agg(row_count(), spent(), received())
    if month:
        result = result.withColumn("month", F.lit(month))
    if category:
        result = result.withColumn("category_filter", F.lit(category))
    if account_type:
        result = result.withColumn("account_type", F.lit(account_type))
    return result


@named("bank.by_month")
def by_month(ledger: DataFrame, account_type: str = None, months: int = 12,
             cap: int | None = 60) -> DataFrame:
    return (
        where(ledger, _account(account_type))
        .groupBy(dates.month_key(F.col("date")).alias("month"))
        .agg(row_count(), spent(), received())
        .orderBy(F.desc("month"))
        .limit(capped(months, cap))
    )


@named("bank.find")
def find(ledger: DataFrame, account_type=None, category=None, start_date=None, end_date=None,
         min_amount=None, max_amount=None, transaction_type=None, description=None,
         bank_name=None, limit: int = 50, cap: int | None = 100) -> DataFrame:
    """Search with any mix of filters; type and bank are compared as given."""
    date, amount = F.col("date"), F.col("amount")
    chosen = where(
        ledger,
        _account(account_type),
        holds(F.col("category"), category) if category else None,
        date >= F.lit(start_date).cast("date") if start_date else None,
        date <= F.lit(end_date).cast("date") if end_date else None,
        amount >= min_amount if min_amount is not None else None,
        amount <= max_amount if max_amount is not None else None,
        F.col("transaction_type") == transaction_type if transaction_type else None,
        holds(F.col("description"), description) if description else None,
        F.col("bank_name") == bank_name if bank_name else None,
    )
    return newest_first(chosen, capped(limit, cap))


_BY_CATEGORY = ["date", "description", "clean_description", "amount", "transaction_type",
                "category", "account_type", "bank_name"]


@named("bank.by_category")
def by_category(ledger: DataFrame, category: str, year=None, month=None, account_type=None,
                transaction_type=None, limit: int = 100, cap: int | None = 200) -> DataFrame:
    chosen = where(
        _with_clean(ledger),
        holds(F.col("category"), category),
        _period(year, month),
        _account(account_type),
        F.col("transaction_type") == transaction_type.upper() if transaction_type else None,
    )
    return newest_first(chosen.select("id", *_BY_CATEGORY, "balance"), capped(limit, cap))


def _investments(ledger, year, month):
    return where(ledger, holds(F.col("category"), "investment"), _period(year, month))


@named("bank.investment_summary")
def investment_summary(ledger: DataFrame, year=None, month=None) -> DataFrame:
    debit, credit = (total(F.col("amount"), test) for test in (is_debit(), is_credit()))
    result = _investments(ledger, year, month).agg(
        row_count(),
        dollars(debit).alias("total_invested"),
        dollars(credit).alias("total_returned"),
        dollars(debit - credit).alias("net_outflow"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    if year:
        result = result.withColumn("year_filter", F.lit(year))
    if month:
        result = result.withColumn("month_filter", F.lit(month))
    return result


@named("bank.investment_rows")
def investment_rows(ledger: DataFrame, year=None, month=None, limit: int = 200,
                    cap: int | None = 200) -> DataFrame:
    chosen = _investments(_with_clean(ledger), year, month)
    return newest_first(chosen.select("id", *_BY_CATEGORY), capped(limit, cap))


@named("bank.balances")
def balances(ledger: DataFrame, account_type: str = None) -> DataFrame:
    """Rows of the latest date with a balance, per account; ties are all kept."""
    known = where(ledger, _account(account_type), F.col("balance").isNotNull())
    columns = ["account_type", "date", "balance", "description"]
    columns = (["id"] if has(ledger, "id") else []) + columns
    return latest_rows(known.select(*columns), ["account_type"], "date").orderBy("account_type")


@named("bank.uncategorized")
def uncategorized(ledger: DataFrame, account_type: str = None, limit: int = 50,
                  cap: int | None = 100) -> DataFrame:
    """Debits marked `Uncategorized`; a null category does not count here."""
    gap = (F.col("category") == "Uncategorized") & is_debit()
    return (
        where(ledger, gap, _account(account_type))
        .orderBy(F.desc("amount"), "id")
        .limit(capped(limit, cap))
    )


@named("bank.statements")
def statements(registry: DataFrame) -> DataFrame:
    return registry.select(
        "id", "filename", "bank_name", "statement_period_start", "statement_period_end",
        "import_date", "total_transactions", "total_debits", "total_credits",
    ).orderBy(F.desc("statement_period_end"), "id")


@named("bank.loan_summary")
def loan_summary(loans: DataFrame, months: int = 12, cap: int | None = 60) -> DataFrame:
    """Loan payments by month; the ending balance is the lowest one."""
    return (
        loans.groupBy(dates.month_key(F.col("date")).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("payment_count"),
            dollars(F.sum("payment_amount")).alias("total_payment"),
            dollars(F.sum("principal_amount")).alias("total_principal"),
            dollars(F.sum("interest_amount")).alias("total_interest"),
            dollars(F.min("balance")).alias("ending_balance"),
        )
        .orderBy(F.desc("month"))
        .limit(capped(months, cap))
    )


@named("bank.loan_rows")
def loan_rows(loans: DataFrame, start_date=None, end_date=None, limit: int = 50,
              tie_break=("id",), cap: int | None = 100) -> DataFrame:
    date = F.col("date")
    chosen = where(
        loans,
        date >= F.lit(start_date).cast("date") if start_date else None,
        date <= F.lit(end_date).cast("date") if end_date else None,
    )
    return chosen.orderBy(F.desc("date"), *tie_break).limit(capped(limit, cap))


@named("bank.loan_totals")
def loan_totals(loans: DataFrame) -> DataFrame:
    return loans.agg(
        F.count(F.lit(1)).alias("payment_count"),
        dollars(F.sum("payment_amount")).alias("total_payment"),
        dollars(F.sum("principal_amount")).alias("total_principal"),
        dollars(F.sum("interest_amount")).alias("total_interest"),
    )


@named("bank.account_types")
def account_types(ledger: DataFrame) -> DataFrame:
    return (
        ledger.groupBy("account_type")
        .agg(spent(), received(), row_count())
        .orderBy("account_type")
    )
