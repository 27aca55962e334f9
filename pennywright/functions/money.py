"""Money: decimals inside, doubles only at the edge of a result."""

from pyspark.sql import Column, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.matching import contains_any

MONEY = "decimal(18,2)"


def zero() -> Column:
    return F.lit("0").cast(MONEY)


def total(amount: Column, when: Column | None = None) -> Column:
    """Exact decimal sum; rows outside `when` count as zero, no rows gives null."""
    return F.sum(amount if when is None else F.when(when, amount).otherwise(zero()))


def dollars(amount: Column) -> Column:
    return amount.cast("double")


def mean(amount: Column, when: Column | None = None) -> Column:
    """Average rounded to cents, half up, from the exact sum; null without rows."""
    value = amount if when is None else F.when(when, amount)
    return F.round(F.sum(value) / F.nullif(F.count(value), F.lit(0)), 2)


def is_debit(kind: Column = None) -> Column:
    return (F.col("transaction_type") if kind is None else kind) == "DEBIT"


def is_credit(kind: Column = None) -> Column:
    return (F.col("transaction_type") if kind is None else kind) == "CREDIT"


def parse_amount(raw: Column, csv: bool = False) -> Column:
    """Signed decimal from text: `-` in front or any `(` makes it negative.

    Unreadable text is null.  With `csv`, nan / none / - also count as missing.
    """
    digits = F.regexp_replace(raw, r"[^\d.]", "")
    value = digits.try_cast(MONEY)
    negative = raw.startswith("-") | raw.contains("(")
    signed = F.when(negative, -value).otherwise(value).cast(MONEY)
    if csv:
        signed = F.when(~F.lower(raw).isin("nan", "none", "-"), signed)
    return signed


def python_float_text(amount: Column) -> Column:
    """`str(float)` of a cent amount: 5.50 -> 5.5, 3000.00 -> 3000.0."""
    return F.regexp_replace(amount.cast(MONEY).cast("string"), r"0$", "")


def line_type(line: Column, amount: Column) -> Column:
    """Type of a free-text line: parentheses, sign, credit words, debit words."""
    lower = F.lower(line)
    return (
        F.when(line.rlike(r"\([\$\d,. ]+\)"), "DEBIT")
        .when(amount < 0, "DEBIT")
        .when(contains_any(lower, fv.CREDIT_WORDS), "CREDIT")
        .when(contains_any(lower, fv.DEBIT_WORDS), "DEBIT")
        .otherwise("UNKNOWN")
    )


def row_type(explicit: Column, description: Column) -> Column:
    """Type of a structured row: stated type, credit words, else DEBIT."""
    stated = F.upper(explicit)
    return (
        F.when(stated.isin("DEBIT", "CREDIT"), stated)
        .when(contains_any(F.lower(description), fv.CREDIT_WORDS), "CREDIT")
        .otherwise("DEBIT")
    )


def csv_amount(debit: Column, credit: Column, single: Column, kind: Column) -> Column:
    """struct(amount, transaction_type) of a CSV row.

    A non-zero debit wins, then a non-zero credit, then the single amount whose
    type comes from the type column, the sign, or defaults to DEBIT.
    """
    dr, cr, one = (parse_amount(F.trim(c), csv=True) for c in (debit, credit, single))
    stated = F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    one_type = (
        F.when(stated.isin("DEBIT", "CREDIT"), stated)
        .when((one >= 0) & stated.contains("CREDIT"), "CREDIT")
        .otherwise("DEBIT")
    )
    dr_used = F.nullif(dr, zero())
    cr_used = F.nullif(cr, zero())
    return F.struct(
        F.coalesce(dr_used, cr_used, one).alias("amount"),
        F.when(dr_used.isNotNull(), "DEBIT")
        .when(cr_used.isNotNull(), "CREDIT")
        .when(one.isNotNull(), one_type)
        .otherwise("UNKNOWN")
        .alias("transaction_type"),
    )


def loan_interest(payment: Column, principal: Column) -> Column:
    """Payment less the principal part, never below zero."""
    return F.greatest(payment - F.abs(principal), zero()).cast(MONEY)


def signed_type(amount: Column, description: Column) -> Column:
    """Credit-union rule: the sign decides, words only for a zero amount."""
    text = F.upper(F.substring_index(description, " | ", 1))
    return (
        F.when(amount > 0, "CREDIT")
        .when(amount < 0, "DEBIT")
        .when(contains_any(text, fv.DCU_CREDIT_WORDS), "CREDIT")
        .otherwise("DEBIT")
    )


def feed_type(amount: Column) -> Column:
    """Card feed: positive amounts leave the account."""
    return F.when(amount < 0, "CREDIT").otherwise("DEBIT")


def position_values(quantity: Column, avg_cost: Column, price: Column) -> dict:
    """Equity and percent change of a position, both rounded to cents."""
    change = F.when(avg_cost == 0, F.lit(0)).otherwise((price - avg_cost) / avg_cost * 100)
    return {
        "equity": F.round(quantity * price, 2),
        "pct_change": F.round(change, 2),
    }
