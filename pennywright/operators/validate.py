"""Table rules as queries: what breaks them comes back as rows."""

from pyspark.sql import Column, DataFrame, functions as F

from pennywright.operators.joins import orphans

KINDS = ("DEBIT", "CREDIT", "UNKNOWN")
ACCOUNTS = ("checking", "savings")


def raw_problems(bank: bool = False) -> Column:
    """Array with a reason for each rule a raw row breaks."""
    checks = [
        F.when(F.col(c).isNull(), F.lit(f"{c} is missing"))
        for c in ("date", "description", "amount")
    ]
    checks.append(F.when(~F.coalesce(F.col("transaction_type"), F.lit("")).isin(*KINDS),
                         F.lit("transaction_type is unknown")))
    if bank:
        checks.append(F.when(~F.coalesce(F.col("account_type"), F.lit("")).isin(*ACCOUNTS),
                             F.lit("account_type is unknown")))
    return F.filter(F.array(*checks), lambda reason: reason.isNotNull())


def invalid_rows(rows: DataFrame, bank: bool = False) -> DataFrame:
    return rows.withColumn("problems", raw_problems(bank)).filter(F.size("problems") > 0)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that are meant to be unique and are not; counted before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str,
                    parent_key: str = "id") -> DataFrame:
    return orphans(child, parent, child_key, parent_key)


def amount_problems(rows: DataFrame) -> DataFrame:
    """Rows with a negative or missing amount, no date, or no description."""
    return rows.filter(
        F.col("amount").isNull() | (F.col("amount") < 0) | F.col("date").isNull()
        | F.col("description").isNull()
    )


def loan_mismatches(loans: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Loan rows whose principal and interest do not add up to the payment."""
    difference = F.abs(
        F.col("principal_amount") + F.col("interest_amount") - F.col("payment_amount")
    )
    return loans.filter(difference > tolerance)
