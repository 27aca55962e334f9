"""Raw rows as a stream -> enriched log, newest result per raw_id."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pennywright.streaming.batches import (
    FAN, compact, current_rows, newest_rows, read_log, run_available, write_batch,
)


def enrich_stream(raw: DataFrame, enrich: Callable[[DataFrame], DataFrame], log: str,
                  checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Enrich each micro-batch with a batch function and append it to the log, which is compacted."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = enrich(batch)
        write_batch(rows, log, batch_id)
        compact(batch.sparkSession, log, rows.schema,
                lambda some: newest_rows(some, "raw_id", "batch_id"), batch_id, fan)

    return run_available(raw, each, checkpoint)


def enriched(spark: SparkSession, log: str, schema) -> DataFrame:
    """The enriched table the log stands for: one row per raw_id."""
    return current_rows(read_log(spark, log, schema), "raw_id", "batch_id")
