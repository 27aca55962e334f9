"""Statement files -> statements, bank rows, loan rows; all files in one job."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pennywright.functions.money import dollars
from pennywright.operators import statements as st, tables
from pennywright.sources import statement_text
from pennywright.sources.scratch import written


@dataclass
class Ingested:
    statements: DataFrame
    bank_rows: DataFrame
    loan_rows: DataFrame | None


def ingest_lines(lines: DataFrame, fmt: str, files: DataFrame = None) -> Ingested:
    """Parse the lines of one format; `files` has one row per file_id.

    Sections and rows are tables in the shared folder: they are read several
    times, and a lost executor must not mean parsing the text again.
    """
    if files is None:
        files = lines.select("file_id").distinct()
    if fmt == "dcu":
        sections = written(st.dcu_sections(lines))
        loans = written(st.dcu_loan(lines, sections))
        rows = written(st.bank_rows({fmt: lines}, sections))
    else:
        loans, rows = None, written(st.bank_rows({fmt: lines}))
    meta = st.statement_metadata(files.drop("bank_name"), lines, rows, fmt, loans)
    return Ingested(meta, rows, loans)


def ingest_files(files: DataFrame, registry: DataFrame) -> Ingested:
    """New files of any format -> numbered statements and rows with statement_id.

    `files` has original_path, filename, content and file_hash; `registry` has id
    and file_hash of what was imported before.  Copies are dropped before any
    text is split into lines; each file's text is read once after that.
    """
    fresh = written(tables.new_statements(registry, files.drop("content"))
                    .withColumnRenamed("id", "file_id"))
    texts = files.select("original_path", "content").join(
        fresh.select("original_path", "file_id", "filename"), "original_path")
    lines = written(statement_text.to_lines(
        statement_text.with_format(texts), ["file_id", "bank_fmt"]))
    # a file without a line that says anything is a statement without rows
    formats = fresh.join(lines.select("file_id", "bank_fmt").distinct(), "file_id", "left")
    formats = formats.withColumn("bank_fmt", F.coalesce("bank_fmt", F.lit("dcu")))
    parts = []
    for fmt in ("dcu", "boa", "chase"):
        about = formats.filter(F.col("bank_fmt") == fmt).select(
            "file_id", "filename", "original_path", "file_hash")
        chosen = lines.filter(F.col("bank_fmt") == fmt).drop("bank_fmt")
        parts.append(ingest_lines(chosen, fmt, about))
    statements, rows = parts[0].statements, parts[0].bank_rows
    for part in parts[1:]:
        statements = statements.unionByName(part.statements)
        rows = rows.unionByName(part.bank_rows)
    return Ingested(
        written(statements.withColumnRenamed("file_id", "id")),
        rows.withColumnRenamed("file_id", "statement_id"),
        parts[0].loan_rows.withColumnRenamed("file_id", "statement_id"),
    )


def dry_run(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files by outcome, without parsing or writing anything."""
    return tables.outcome_counts(tables.file_outcomes(registry, files.drop("content")))


def report(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """After an import: rows, sum and date range by account type; statements by bank."""
    accounts = rows.groupBy("account_type").agg(
        F.count(F.lit(1)).alias("n"), dollars(F.sum("amount")).alias("total"),
        F.min("date").alias("earliest"), F.max("date").alias("latest")).select(
        F.lit("account").alias("section"), F.col("account_type").alias("name"), "n", "total",
        "earliest", "latest")
    banks = statements.groupBy("bank_name").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("bank").alias("section"), F.col("bank_name").alias("name"), "n")
    return accounts.unionByName(banks, allowMissingColumns=True)
