"""Keyed tables as snapshots: upserts, inserts, deletes, publishing.

Parquet has no MERGE, so an upsert is a function old snapshot x new rows -> new
snapshot, written next to the old one and never over the path being read.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.money import dollars
from pennywright.operators.joins import compute_once
from pennywright.operators.validate import raw_problems
from pennywright.operators.windows import dense_ids

ENRICHED_COLUMNS = ["clean_description", "merchant_name", "merchant_raw", "category",
                    "subcategory", "location", "confidence_score", "enrichment_method",
                    "enriched_at"]


def coerce(df: DataFrame, ints=tuple(fv.INT_COLUMNS), numbers=tuple(fv.NUMBER_COLUMNS)):
    """Whole-number and number columns by name; text that is not one becomes null."""
    return df.withColumns({
        **{c: F.col(c).try_cast("bigint") for c in df.columns if c in ints},
        **{c: F.col(c).try_cast("double") for c in df.columns if c in numbers},
    })


def upsert_enrichment(old: DataFrame, new: DataFrame, key: str = "raw_id",
                      updated=tuple(ENRICHED_COLUMNS)) -> DataFrame:
    """On a known key only the enrichment columns change; new keys come in whole.

    Both sides hold a key once.  A null in the new enrichment replaces the old.
    """
    old_in, new_in = F.col("o._in").isNotNull(), F.col("n._in").isNotNull()
    joined = old.withColumn("_in", F.lit(1)).alias("o").join(
        new.withColumn("_in", F.lit(1)).alias("n"),
        F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer",
    )

    def value(c):
        if c not in new.columns:
            return F.col(f"o.{c}")
        first = new_in if c in updated else ~old_in
        return F.when(first, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(
        *[F.coalesce(f"o.{key}", f"n.{key}").alias(key) if c == key else value(c)
          for c in old.columns]
    )


def upsert_rows(old: DataFrame, new: DataFrame, key: str = "raw_id") -> DataFrame:
    """On a known key the whole row is replaced."""
    kept = old.join(new.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, unique_keys, defaults: dict = None):
    """Replace old rows that meet a new one on any unique key.

    Columns the new rows do not name go back to their default (or null).
    """
    kept = old
    for key in unique_keys:
        if key in new.columns:
            kept = kept.join(new.select(key).filter(F.col(key).isNotNull()), key, "left_anti")
    kept = kept.select(*old.columns)
    missing = {c: F.lit((defaults or {}).get(c)).cast(old.schema[c].dataType)
               for c in old.columns if c not in new.columns}
    return kept.unionByName(new.withColumns(missing).select(*old.columns))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Defaults of a raw row: UNKNOWN type, Uncategorized, confidence 1.0."""
    defaults = {"transaction_type": "UNKNOWN", "category": "Uncategorized",
                "confidence_score": 1.0, "merchant_name": "", "raw_text": ""}
    return rows.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)
        for c, v in defaults.items()
    })


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows for quarantine with their reasons)."""
    checked = with_defaults(rows).withColumn("problems", raw_problems())
    good = checked.filter(F.size("problems") == 0).drop("problems")
    return good, checked.filter(F.size("problems") > 0)


def max_id(df: DataFrame) -> int:
    """Highest id so far, 0 for an empty table; one number comes to the driver."""
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def new_statements(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose hash is new, one per hash (first path), with ids continued."""
    first = files.groupBy("file_hash").agg(
        *[F.min_by(c, "original_path").alias(c) for c in files.columns
          if c not in ("file_hash", "original_path")],
        F.min("original_path").alias("original_path"),
    )
    fresh = first.join(registry.select("file_hash"), "file_hash", "left_anti")
    return dense_ids(fresh, "file_hash", max_id(registry))


def file_outcomes(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Every file as new, duplicate in this batch, or imported before."""
    first = files.groupBy("file_hash").agg(F.min("original_path").alias("_first"))
    known = registry.select("file_hash", F.lit(True).alias("_known"))
    marks = first.join(known, "file_hash", "left")
    marked = compute_once(
        files, ["file_hash"], lambda keys: keys.join(marks, "file_hash"), "original_path"
    )
    return marked.select(
        *files.columns,
        F.when(F.col("_known"), "imported before")
        .when(F.col("original_path") == F.col("_first"), "new")
        .otherwise("duplicate")
        .alias("outcome"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"))


def rows_per_bank(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows, statements with rows, and amount per bank; rows without a statement do not count.

    Rows are counted per statement before the join, so little is joined.
    """
    counted = rows.groupBy(F.col("statement_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return counted.join(statements.select("id", "bank_name"), "id").groupBy("bank_name").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_statements"),
        dollars(F.sum("amount")).alias("amount"))


def statement_totals(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Statements with their count, debit and credit totals (0 without rows)."""
    debit = F.when(F.col("transaction_type") == "DEBIT", F.col("amount"))
    credit = F.when(F.col("transaction_type") == "CREDIT", F.col("amount"))
    totals = rows.groupBy(F.col("statement_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(debit).alias("total_debits"),
        F.sum(credit).alias("total_credits"),
    )
    names = ["total_transactions", "total_debits", "total_credits"]
    base = statements.select(*[c for c in statements.columns if c not in names])
    return base.join(totals, "id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in names}
    )


def delete_bank(bank: str, statements: DataFrame, raw: DataFrame, enriched: DataFrame):
    """The three tables without one bank: statements, their raw and enriched rows."""
    gone = statements.filter(F.col("bank_name") == bank).select(F.col("id").alias("statement_id"))
    gone_raw = raw.join(gone, "statement_id", "left_semi").select(F.col("id").alias("raw_id"))
    return (
        statements.filter(~F.col("bank_name").eqNullSafe(bank)),
        raw.join(gone, "statement_id", "left_anti"),
        enriched.join(gone_raw, "raw_id", "left_anti"),
    )


def delete_preview(bank: str, statements: DataFrame, raw: DataFrame, enriched: DataFrame):
    """Rows per table that `delete_bank` would drop."""
    gone = statements.filter(F.col("bank_name") == bank).select(F.col("id").alias("statement_id"))
    gone_raw = raw.join(gone, "statement_id", "left_semi")
    gone_enriched = enriched.join(
        gone_raw.select(F.col("id").alias("raw_id")), "raw_id", "left_semi")
    return table_counts({"statements": gone, "raw": gone_raw, "enriched": gone_enriched})


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per table in one job; a missing table counts as -1."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    counts = None
    for name, df in tables.items():
        if df is None:
            one = spark.range(1).select(F.lit(name).alias("table_name"),
                                        F.lit(-1).cast("long").alias("row_count"))
        else:
            one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def emptied(df: DataFrame) -> DataFrame:
    """The table with its schema and no rows."""
    return df.limit(0)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both frames together; columns only one of them has are null in the other."""
    return old.unionByName(new, allowMissingColumns=True)


def publish_both(df: DataFrame, first: str, second: str, batch_id: int) -> None:
    """Write a batch to two places; the first only ever shows batches both have.

    Each batch owns its folder, so a repeated call replaces it.
    """
    part = f"batch_id={batch_id}"
    df.write.mode("overwrite").parquet(f"{second}/{part}")
    df.write.mode("overwrite").parquet(f"{first}/{part}")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots under `path`."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(root)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(name[1:]) for name in done if name.startswith("v") and name[1:].isdigit())


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete snapshot, or None."""
    numbers = snapshots(spark, path)
    return spark.read.parquet(f"{path}/v{numbers[-1]}") if numbers else None


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write the next snapshot; readers move on once it is complete."""
    numbers = snapshots(df.sparkSession, path)
    target = f"{path}/v{(numbers[-1] if numbers else 0) + 1}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)
