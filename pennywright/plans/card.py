"""Named queries over the card ledger.

A ledger frame has id, date, description, amount (never negative),
transaction_type (DEBIT / CREDIT / UNKNOWN), merchant_name, category and, once
enriched, clean_description, subcategory, location and confidence_score.
"""

from pyspark.sql import DataFrame, functions as F

from pennywright.functions import dates, fixed_values as fv
from pennywright.functions.money import dollars, is_credit, is_debit, mean, total
from pennywright.functions.text import holds
from pennywright.plans.common import (
    capped, has, narrowed, newest_first, received, row_count, spent, where,
)
from pennywright.plans.registry import named


def _named_merchant():
    return F.col("merchant_name").isNotNull() & (F.col("merchant_name") != "")


@named("card.categories")
def categories(ledger: DataFrame) -> DataFrame:
    return (
        ledger.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(row_count(), spent(), received())
        .orderBy(F.desc("total_spent"), "category")
    )


@named("card.subcategories")
def subcategories(ledger: DataFrame, category: str) -> DataFrame:
    return (
        ledger.filter(F.lower("category") == category.lower())
        .filter(F.col("subcategory").isNotNull())
        .groupBy("subcategory")
        .agg(row_count(), spent(), received())
        .orderBy(F.desc("total_spent"), "subcategory")
    )


@named("card.merchants")
def merchants(ledger: DataFrame, limit: int = 20, cap: int | None = 100) -> DataFrame:
    """Most frequent merchants (not the most expensive)."""
    return (
        ledger.filter(_named_merchant())
        .groupBy("merchant_name")
        .agg(
            row_count(),
            spent(),
            dollars(mean(F.col("amount"), is_debit())).alias("avg_amount"),
            F.min("date").alias("first_seen"),
            F.max("date").alias("last_seen"),
        )
        .orderBy(F.desc("transaction_count"), "merchant_name")
        .limit(capped(limit, cap))
    )


@named("card.summary")
def spending_summary(ledger: DataFrame, month: str = None, category: str = None) -> DataFrame:
    """One row; an empty selection has count 0 and null sums."""
    chosen = where(
        ledger,
        dates.in_month(F.col("date"), month) if month else None,
        holds(F.col("category"), category) if category else None,
    )
    result = chosen.agg(
        row_count(),
        spent(),
        received(),
        dollars(mean(F.col("amount"), is_debit())).alias("avg_debit"),
        dollars(F.max("amount")).alias("largest_transaction"),
        F.min("date").alias("period_start"),
        F.max("date").alias("period_end"),
    )
    if month:
        result = result.withColumn("month", F.lit(month[:7]))
    if category:
        result = result.withColumn("category_filter", F.lit(category))
    return result


@named("card.by_month")
def spending_by_month(ledger: DataFrame, months: int = 6, cap: int | None = 24) -> DataFrame:
    return (
        ledger.groupBy(dates.month_key(F.col("date")).alias("month"))
        .agg(
            row_count(),
            spent(),
            received(),
            dollars(mean(F.col("amount"), is_debit())).alias("avg_debit"),
        )
        .orderBy(F.desc("month"))
        .limit(capped(months, cap))
    )


_FOUND = ["id", "date", "description", "clean_description", "amount", "transaction_type",
          "merchant_name", "category", "subcategory", "location", "bank_name", "balance",
          "confidence_score"]
_FOUND_RAW = ["id", "date", "description", "amount", "transaction_type", "merchant_name",
              "category", "bank_name", "balance"]


@named("card.find")
def find(ledger: DataFrame, merchant=None, category=None, start_date=None, end_date=None,
         min_amount=None, max_amount=None, transaction_type=None, bank_name=None,
         limit: int = 20, cap: int | None = 100) -> DataFrame:
    """Search with any mix of filters; raw ledgers give fewer columns."""
    date, amount = F.col("date"), F.col("amount")
    chosen = where(
        ledger,
        holds(F.col("merchant_name"), merchant) if merchant else None,
        holds(F.col("category"), category) if category else None,
        date >= F.lit(start_date).cast("date") if start_date else None,
        date <= F.lit(end_date).cast("date") if end_date else None,
        amount >= min_amount if min_amount is not None else None,
        amount <= max_amount if max_amount is not None else None,
        F.col("transaction_type") == transaction_type.upper() if transaction_type else None,
        F.col("bank_name") == bank_name.lower() if bank_name else None,
    )
    columns = _FOUND if has(ledger, "subcategory") else _FOUND_RAW
    return newest_first(narrowed(chosen, columns), capped(limit, cap))


@named("card.list")
def listing(ledger: DataFrame, limit: int = 100, transaction_type=None, start_date=None,
            end_date=None, merchant=None, bank_name=None) -> DataFrame:
    """Whole rows, newest first; this limit has no cap."""
    date = F.col("date")
    chosen = where(
        ledger,
        F.col("transaction_type") == transaction_type.upper() if transaction_type else None,
        date >= F.lit(start_date).cast("date") if start_date else None,
        date <= F.lit(end_date).cast("date") if end_date else None,
        holds(F.col("merchant_name"), merchant) if merchant else None,
        F.col("bank_name") == bank_name.lower() if bank_name else None,
    )
    return newest_first(chosen, int(limit))


@named("card.by_merchant")
def by_merchant(ledger: DataFrame, merchant: str) -> DataFrame:
    """Every row of a merchant, newest first, without a limit."""
    return ledger.filter(holds(F.col("merchant_name"), merchant)).orderBy(F.desc("date"), "id")


@named("card.merchant_total")
def merchant_total(ledger: DataFrame, merchant: str) -> DataFrame:
    return ledger.filter(holds(F.col("merchant_name"), merchant)).agg(
        row_count(), dollars(F.sum("amount")).alias("total")
    )


@named("card.duplicates")
def duplicates(ledger: DataFrame, days_window: int = 3) -> DataFrame:
    """Same merchant and amount more than once, all within `days_window` days."""
    return (
        ledger.filter(is_debit() & _named_merchant())
        .groupBy("merchant_name", "amount")
        .agg(
            F.count(F.lit(1)).alias("occurrence_count"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .withColumn("days_apart", dates.day_distance(F.col("first_date"), F.col("last_date")))
        .filter((F.col("occurrence_count") > 1) & (F.col("days_apart") <= days_window))
        .withColumn("amount", dollars(F.col("amount")))
        .orderBy(F.desc("occurrence_count"), F.desc("amount"), "merchant_name")
    )


@named("card.uncategorized")
def uncategorized(ledger: DataFrame, limit: int = 20, cap: int | None = 100) -> DataFrame:
    """Debits without a category or a merchant, largest first."""
    gap = (
        F.col("category").isNull()
        | (F.col("category") == "Uncategorized")
        | F.col("merchant_name").isNull()
        | (F.col("merchant_name") == "")
    )
    return (
        ledger.filter(gap & is_debit())
        .select("id", "date", "description", "amount", "transaction_type", "merchant_name",
                "category", "bank_name")
        .orderBy(F.desc("amount"), "id")
        .limit(capped(limit, cap))
    )


@named("card.statements")
def statements(registry: DataFrame) -> DataFrame:
    return registry.select(
        "id", "filename", "bank_name", "statement_date", "import_date", "total_transactions",
        "total_debits", "total_credits",
    ).orderBy(F.desc("import_date"), "id")


@named("card.subcategory_summary")
def subcategory_summary(ledger: DataFrame, subcategory=None, month=None,
                        bank_name=None) -> DataFrame:
    """Debits by (subcategory, category); a raw ledger gives no rows."""
    if not has(ledger, "subcategory"):
        ledger = ledger.withColumn("subcategory", F.lit(None).cast("string"))
    chosen = where(
        ledger.filter(is_debit() & F.col("subcategory").isNotNull()),
        holds(F.col("subcategory"), subcategory) if subcategory else None,
        dates.in_month(F.col("date"), month) if month else None,
        F.lower("bank_name") == bank_name.lower() if bank_name else None,
    )
    return (
        chosen.groupBy("subcategory", "category")
        .agg(
            row_count(),
            dollars(F.sum("amount")).alias("total_spent"),
            (dollars(F.sum("amount")) / F.count("amount")).alias("avg_transaction"),
            dollars(F.min("amount")).alias("min_amount"),
            dollars(F.max("amount")).alias("max_amount"),
        )
        .orderBy(F.desc("total_spent"), "subcategory", "category")
    )


@named("card.stats")
def stats(ledger: DataFrame) -> DataFrame:
    """Totals of the whole ledger; an empty one gives zeros, not nulls."""
    amount = F.col("amount")
    sums = ledger.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(total(amount, is_debit()), F.lit(0)).alias("debits"),
        F.coalesce(total(amount, is_credit()), F.lit(0)).alias("credits"),
        F.count(F.when(is_debit(), 1)).alias("debit_count"),
        F.coalesce(dollars(F.max(amount)), F.lit(0.0)).alias("largest_transaction"),
    )
    return sums.select(
        "total",
        dollars(F.col("debits")).alias("total_debits"),
        dollars(F.col("credits")).alias("total_credits"),
        F.coalesce(dollars(F.col("debits")) / F.nullif(F.col("debit_count"), F.lit(0)),
                   F.lit(0.0)).alias("avg_debit"),
        "largest_transaction",
        dollars(F.col("credits") - F.col("debits")).alias("net"),
    )


@named("card.monthly")
def monthly(ledger: DataFrame) -> DataFrame:
    """Spending and income of every month."""
    return (
        ledger.groupBy(dates.month_key(F.col("date")).alias("month"))
        .agg(
            dollars(total(F.col("amount"), is_debit())).alias("spending"),
            dollars(total(F.col("amount"), is_credit())).alias("income"),
            row_count(),
        )
        .orderBy(F.desc("month"))
    )


@named("card.largest")
def largest(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("amount"), "id").limit(1)


@named("card.known_categories")
def known_categories(ledger: DataFrame) -> DataFrame:
    """By category without `Uncategorized` and without rounding."""
    return (
        ledger.filter(F.col("category") != "Uncategorized")
        .groupBy("category")
        .agg(spent(), received(), row_count())
        .orderBy(F.desc("total_spent"), "category")
    )


@named("card.merchants_by_spend")
def merchants_by_spend(ledger: DataFrame, limit: int = 10) -> DataFrame:
    return (
        ledger.filter(F.col("merchant_name").isNotNull())
        .groupBy("merchant_name")
        .agg(spent(), row_count())
        .orderBy(F.desc("total_spent"), "merchant_name")
        .limit(int(limit))
    )


@named("card.overall")
def overall(ledger: DataFrame) -> DataFrame:
    """Totals with the number of distinct months.

    Grouping by month first keeps the distinct count to a handful of rows.
    """
    months = ledger.groupBy(dates.month_key(F.col("date")).alias("month")).agg(
        total(F.col("amount"), is_debit()).alias("spent"),
        total(F.col("amount"), is_credit()).alias("received"),
        F.count(F.lit(1)).alias("n"),
    )
    return months.agg(
        dollars(F.sum("spent")).alias("total_spent"),
        dollars(F.sum("received")).alias("total_received"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_transactions"),
        F.count("month").alias("months_of_data"),
    )


@named("card.top_categories_of_year")
def top_categories_of_year(ledger: DataFrame, as_of: str, limit: int = 5) -> DataFrame:
    return (
        ledger.filter(is_debit() & dates.this_year(F.col("date"), as_of))
        .groupBy("category")
        .agg(dollars(F.sum("amount")).alias("total"))
        .orderBy(F.desc("total"), "category")
        .limit(limit)
    )


def spelled(term: str, *columns: str):
    """Any spelling of a merchant in any of the columns, upper or lower case."""
    spellings = fv.MERCHANT_SPELLINGS.get(term.lower(), [term.lower()])
    test = F.lit(False)
    for column in columns:
        lower = F.lower(F.coalesce(F.col(column), F.lit("")))
        for spelling in spellings:
            test = test | lower.contains(spelling)
    return test


@named("card.merchant_charges")
def merchant_charges(ledger: DataFrame, merchant: str, start_date: str, end_date: str,
                     columns=("merchant_name", "description")) -> DataFrame:
    """Charges of a merchant under all its spellings between two dates."""
    between = F.col("date").between(F.lit(start_date).cast("date"), F.lit(end_date).cast("date"))
    return (
        ledger.filter(is_debit() & between & spelled(merchant, *columns))
        .select("id", "date", "description", "merchant_name", "amount")
        .orderBy("date", "id")
    )


@named("card.merchant_by_month")
def merchant_by_month(ledger: DataFrame, merchant: str, year: str) -> DataFrame:
    return (
        ledger.filter(is_debit() & dates.in_year(F.col("date"), year)
                      & spelled(merchant, "merchant_name", "description"))
        .groupBy(dates.month_key(F.col("date")).alias("month"))
        .agg(dollars(F.sum("amount")).alias("total_spent"))
        .orderBy("month")
    )


def term_filter(term: str):
    """Rows of an everyday term: its category, or one of its merchants."""
    category, subcategory, names = fv.TERM_TAXONOMY[term]
    test = F.col("category") == category
    if subcategory:
        test = test & (F.col("subcategory") == subcategory)
    for name in names:
        test = test | F.lower(F.coalesce(F.col("merchant_name"), F.lit(""))).contains(name)
    return F.coalesce(test, F.lit(False))


@named("card.term_charges")
def term_charges(ledger: DataFrame, term: str, as_of: str) -> DataFrame:
    return (
        ledger.filter(is_debit() & dates.this_year(F.col("date"), as_of) & term_filter(term))
        .select("id", "date", "merchant_name", "category", "amount")
        .orderBy(F.desc("date"), "id")
    )


@named("card.in_categories")
def in_categories(ledger: DataFrame, names, limit: int = 20) -> DataFrame:
    chosen = ledger.filter(F.col("category").isin(*names)).select(
        "id", "date", "description", "amount", "merchant_name", "category"
    )
    return newest_first(chosen, limit)


@named("card.duplicates_last_month")
def duplicates_last_month(ledger: DataFrame, as_of: str) -> DataFrame:
    """Repeated (merchant, amount) of last month, whatever the days between."""
    return (
        ledger.filter(is_debit() & dates.last_month(F.col("date"), as_of))
        .groupBy("merchant_name", "amount")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt") > 1)
        .withColumn("amount", dollars(F.col("amount")))
        .orderBy(F.desc("cnt"), F.desc("amount"), "merchant_name")
    )


@named("card.period_totals")
def period_totals(ledger: DataFrame, as_of: str, category: str, subcategory: str) -> DataFrame:
    """Spent last month, received this month and one taxonomy leaf this year; one scan."""
    date, amount = F.col("date"), F.col("amount")
    leaf = (F.col("category") == category) & (F.col("subcategory") == subcategory)
    start = F.least(
        F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -1),
        F.trunc(F.lit(as_of).cast("date"), "YEAR"),
    )
    return ledger.filter(date >= start).agg(
        dollars(F.sum(F.when(is_debit() & dates.last_month(date, as_of), amount)))
        .alias("spent_last_month"),
        dollars(F.sum(F.when(is_credit() & dates.this_month(date, as_of), amount)))
        .alias("received_this_month"),
        dollars(F.sum(F.when(is_debit() & leaf & dates.this_year(date, as_of), amount)))
        .alias("leaf_this_year"),
    )


@named("card.busiest_bank")
def busiest_bank(ledger: DataFrame, as_of: str) -> DataFrame:
    return (
        ledger.filter(dates.last_month(F.col("date"), as_of))
        .groupBy("bank_name")
        .agg(F.count(F.lit(1)).alias("txn_count"))
        .orderBy(F.desc("txn_count"), "bank_name")
        .limit(1)
    )


@named("card.low_confidence")
def low_confidence(ledger: DataFrame, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    return (
        ledger.filter(F.col("confidence_score") < threshold)
        .select("id", "date", "description", "merchant_name", "category", "confidence_score")
        .orderBy("confidence_score", "id")
        .limit(limit)
    )


@named("card.signed_spend")
def signed_spend(rows: DataFrame) -> DataFrame:
    """Spend by category of signed rows: only negative amounts count."""
    return (
        rows.filter(F.col("amount") < 0)
        .groupBy("category")
        .agg(dollars(F.sum(F.abs("amount"))).alias("total"))
        .orderBy(F.desc("total"), "category")
    )


@named("card.combined")
def combined(card: DataFrame, bank: DataFrame) -> DataFrame:
    """Card and bank rows in one frame, tagged by ledger."""
    return card.withColumn("ledger", F.lit("card")).unionByName(
        bank.withColumn("ledger", F.lit("bank")), allowMissingColumns=True
    )
