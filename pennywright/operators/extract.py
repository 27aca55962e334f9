"""Free-text and structured rows -> transactions."""

from pyspark.sql import DataFrame, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.dates import parse_date
from pennywright.functions.money import (
    line_type, parse_amount, python_float_text, row_type,
)
from pennywright.functions.text import is_header_line, squeeze, strip, with_line_merchant


def line_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add date_text, amount (signed) and description to lines.

    Each step is its own projection, so that no regex runs twice for one row.
    """
    text = F.col(line)
    found = lines.withColumn(line, strip(text)).withColumns({
        "date_text": F.nullif(F.regexp_extract(text, "(?i)" + fv.LINE_DATE, 0), F.lit("")),
        "_amount": F.regexp_extract(text, fv.LINE_AMOUNT, 0),
    })
    found = found.withColumn("amount", parse_amount(F.col("_amount"))).drop("_amount")
    return found.withColumn("description", _description(line))


def _description(line: str):
    """The line without the date, the amount as a float prints it, and $ ( )."""
    rest = F.replace(F.col(line), F.col("date_text"), F.lit(""))
    rest = F.replace(rest, python_float_text(F.col("amount")), F.lit(""))
    return squeeze(F.regexp_replace(rest, r"[$()]", ""))


def line_transactions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Transactions of free-text lines; lines without a date or amount give none."""
    kept = lines.filter((strip(F.col(line)) != "") & ~is_header_line(F.col(line)))
    dated = F.col(line).rlike("(?i)" + fv.LINE_DATE) & F.col(line).rlike(fv.LINE_AMOUNT)
    found = line_fields(kept.filter(dated), line)
    found = found.withColumn("parsed_date", parse_date(F.col("date_text")))
    typed = found.withColumns({
        "transaction_type": line_type(F.col(line), F.col("amount")),
        "amount": F.abs("amount"),
        "confidence_score": F.round(
            F.lit(0.4) + 0.4 + F.when(F.length("description") > 3, 0.2).otherwise(0.0), 2
        ),
        "raw_text": F.col(line),
    })
    return with_line_merchant(typed).filter(F.col("parsed_date").isNotNull())


def structured_transactions(rows: DataFrame) -> DataFrame:
    """Transactions of rows with text columns date, description, amount, type, balance."""
    typed = rows.withColumns({
        "date": parse_date(F.col("date")),
        "description": strip(F.coalesce("description", F.lit(""))),
        "amount": parse_amount(F.col("amount")),
        "transaction_type": row_type(F.coalesce("type", F.lit("")), F.col("description")),
        "balance": parse_amount(F.col("balance")),
        "confidence_score": F.lit(1.0),
    }).filter(F.col("date").isNotNull() & F.col("amount").isNotNull())
    return with_line_merchant(typed)
