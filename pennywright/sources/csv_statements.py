"""CSV statements: header spellings, encodings, normalised rows."""

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.dates import parse_date
from pennywright.functions.money import MONEY, csv_amount, parse_amount
from pennywright.functions.text import strip, with_line_merchant
from pennywright.sources.statement_text import BREAK, decoded


def column_mapping(columns) -> dict[str, str]:
    """Logical field -> column, by the first header spelling present.

    A date and an amount (or debit) column are required.
    """
    by_name = {c.lower().strip(): c for c in columns}
    mapping = {}
    for field, spellings in fv.CSV_ALIASES.items():
        found = [by_name[s] for s in spellings if s in by_name]
        if found:
            mapping[field] = found[0]
    if "date" not in mapping:
        raise ValueError("no date column in CSV")
    if "amount" not in mapping and "debit" not in mapping:
        raise ValueError("no amount or debit column in CSV")
    return mapping


def read_csv(spark: SparkSession, path, encoding: str = "UTF-8",
             multi_line: bool = True) -> DataFrame:
    """All columns as text under their header names; files have one header.

    Quotes in quoted values are doubled.  A quoted value may hold line breaks; without
    `multi_line` it may not, and large files are split across tasks.
    """
    return (
        spark.read.option("header", True).option("encoding", encoding)
        .option("escape", '"').option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def read_folder(spark: SparkSession, path, encoding: str = "UTF-8",
                multi_line: bool = True) -> DataFrame:
    """Transactions of CSV files with any headers, with original_path.

    Files are grouped by their header line; each distinct header is one read with its own
    column mapping.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    headers = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups = headers.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    parts = []
    for group in sorted(groups, key=lambda g: g.header):  # the driver lists the files anyway
        files = [unquote(f) for f in group.files]
        rows = read_csv(spark, files, encoding, multi_line).withColumn(
            "original_path", F.col("_metadata.file_path"))
        parts.append(normalised(rows, ["original_path"]))
    if not parts:
        raise ValueError("no CSV file with a header")
    return reduce(DataFrame.unionByName, parts)


def read_any_encoding(spark: SparkSession, path, header: str) -> DataFrame:
    """CSV files of unknown encoding, each UTF-8 or else Latin-1.

    `header` is their common header line.  Adds original_path.
    """
    files = spark.read.format("binaryFile").load(path)
    lines = files.select(
        F.col("path").alias("original_path"),
        F.posexplode(F.split(decoded(F.col("content")), BREAK)).alias("n", "line"),
    ).filter("n > 0 AND line <> ''")
    schema = ", ".join(f"`{name.strip()}` STRING" for name in header.split(","))
    return lines.select("original_path", F.from_csv("line", schema).alias("r")).select(
        "original_path", "r.*"
    )


def rename_fields(df: DataFrame, keep=()) -> DataFrame:
    """Only the logical fields (and `keep`), under their logical names.

    Separate debit and credit columns count only when both are there.
    """
    mapping = column_mapping([c for c in df.columns if c not in keep])
    both = "debit" in mapping and "credit" in mapping

    def field(name):
        usable = name in mapping and (both or name not in ("debit", "credit"))
        value = F.col(f"`{mapping[name]}`") if usable else F.lit(None)
        return value.cast("string").alias(name)

    return df.select(*keep, *[field(name) for name in fv.CSV_ALIASES])


def normalised(df: DataFrame, keep=()) -> DataFrame:
    """Logical fields -> transactions; rows without date or amount are dropped."""
    rows = rename_fields(df, keep).withColumns({
        "_date": parse_date(F.col("date")),
        "_a": csv_amount(F.col("debit"), F.col("credit"), F.col("amount"), F.col("type")),
        "description": strip(F.coalesce("description", F.lit(""))),
    })
    rows = rows.filter(F.col("_date").isNotNull() & F.col("_a.amount").isNotNull())
    return with_line_merchant(rows).select(
        *keep,
        F.col("_date").alias("date"), "description",
        F.abs("_a.amount").cast(MONEY).alias("amount"),
        F.col("_a.transaction_type").alias("transaction_type"),
        "merchant_name", "category",
        parse_amount(strip(F.col("balance")), csv=True).alias("balance"),
        F.lit(1.0).alias("confidence_score"),
    )


def parse_summary(rows: DataFrame, keys=("original_path",)) -> DataFrame:
    """Count, debits, credits and net (credits less debits) per file."""
    def side(kind):
        return F.coalesce(
            F.sum(F.when(F.col("transaction_type") == kind, F.col("amount"))), F.lit(0)
        )

    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        side("DEBIT").cast("double").alias("total_debits"),
        side("CREDIT").cast("double").alias("total_credits"),
        (side("CREDIT") - side("DEBIT")).cast("double").alias("net"),
    )


def export_csv(df: DataFrame, path: str, date_columns=tuple(fv.DATE_COLUMNS)) -> None:
    """Write with a header, null as nothing, known date texts as yyyy-MM-dd."""
    from pennywright.functions.dates import renormalise_date
    texts = {c: renormalise_date(F.col(c)) for c, t in df.dtypes
             if c in date_columns and t == "string"}
    (df.withColumns(texts) if texts else df).write.option("header", True).option(
        "nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed columns by name: whole numbers, numbers, dates, repaired timestamps."""
    from pennywright.functions.dates import clean_timestamp
    from pennywright.operators.tables import coerce
    df = coerce(spark.read.option("header", True).option("nullValue", "").option(
        "escape", '"').option("multiLine", True).csv(path))
    return df.withColumns({
        **{c: F.col(c).try_cast("date") for c in df.columns if c in fv.DATE_COLUMNS},
        **{c: clean_timestamp(F.col(c)) for c in df.columns if c in fv.TIMESTAMP_COLUMNS},
    })
