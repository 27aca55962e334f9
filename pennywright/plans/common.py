"""Pieces shared by the named queries."""

from pyspark.sql import Column, DataFrame, functions as F

from pennywright.functions.money import dollars, is_credit, is_debit, total


def capped(limit: int, cap: int | None) -> int:
    """`limit`, at most `cap`; None lifts the cap."""
    return int(limit) if cap is None else min(int(limit), cap)


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Keep rows meeting every condition given; None means "not asked for"."""
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def spent() -> Column:
    return dollars(total(F.col("amount"), is_debit())).alias("total_spent")


def received() -> Column:
    return dollars(total(F.col("amount"), is_credit())).alias("total_received")


def row_count() -> Column:
    return F.count(F.lit(1)).alias("transaction_count")


def newest_first(df: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The latest rows; `key` breaks ties so that the result is repeatable."""
    return df.orderBy(F.desc("date"), F.asc(key)).limit(limit)


def active_ledger(enriched: DataFrame | None, raw: DataFrame) -> DataFrame:
    """The enriched ledger if it is there and has a row, else the raw one."""
    if enriched is None or enriched.isEmpty():
        return raw
    return enriched


def has(df: DataFrame, column: str) -> bool:
    return column in df.columns


def narrowed(df: DataFrame, columns) -> DataFrame:
    """The named columns that `df` has."""
    return df.select(*[c for c in columns if c in df.columns])
