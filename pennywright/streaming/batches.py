"""Batch-keyed output of streams.

Every micro-batch owns one folder, batch_id=N, of the target table.  A batch
that runs again after a failure replaces its own folder and nothing else, so
the table is exact however often executors or the driver are lost, and the
cost of a batch does not grow with the table.

Readers do not pay for every batch ever written either: `compact` merges `FAN` neighbouring folders
into one of the next level, FAN of those into one above, and so on.  `read_log` reads the fewest
folders that cover the log, fewer than FAN of each level, and a row is rewritten once per level.
Merged folders stand beside the log, PATH-merged/LEVEL-FIRST-LAST, and count once complete.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_batches(spark: SparkSession, path: str, schema, before: int = None) -> DataFrame:
    """All batches written so far (or those before one), with batch_id."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long"))
    table = spark.read.schema(schema).parquet(path)
    if "batch_id" not in table.columns:
        table = table.withColumn("batch_id", F.lit(0))
    table = table.withColumn("batch_id", F.col("batch_id").cast("long"))
    return table if before is None else table.filter(F.col("batch_id") < before)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_available(stream: DataFrame, each, checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches with `each(df, batch_id)`, then stop."""
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


FAN = 16


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders under a path."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return [s.getPath().getName() for s in fs.listStatus(root)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]


def cover(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(level, first batch, last batch) of the folders to read, in order; level 0 is a batch."""
    found = [(0, int(n[9:]), int(n[9:])) for n in _complete(spark, path) if n.startswith("batch_id=")]
    found += [tuple(map(int, n.split("-"))) for n in _complete(spark, f"{path}-merged")]
    chosen, end = [], -1
    for level, first, last in sorted(found, key=lambda x: (x[1], -x[2])):
        if first > end:
            chosen.append((level, first, last))
            end = last
    return chosen


def read_log(spark: SparkSession, path: str, schema, folders=None) -> DataFrame:
    """The log with batch_id, from the folders of `cover` (or some of them)."""
    folders = cover(spark, path) if folders is None else folders
    empty = spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long"))
    parts = []
    batches = [f"{path}/batch_id={first}" for level, first, _ in folders if not level]
    merged = [f"{path}-merged/{level}-{first}-{last}" for level, first, last in folders if level]
    if batches:
        parts.append(spark.read.schema(empty.schema).option("basePath", path).parquet(*batches))
    if merged:
        parts.append(spark.read.schema(empty.schema).parquet(*merged))
    return reduce(DataFrame.unionByName, parts) if parts else empty


def compact(spark: SparkSession, path: str, schema, merge: Callable[[DataFrame], DataFrame],
            before: int, fan: int = FAN) -> None:
    """Merge full levels of the batches before one with `merge`, which keeps batch_id.

    A merge that dies leaves an unfinished folder, which no reader counts and the next one replaces.
    """
    while True:
        folders = [f for f in cover(spark, path) if f[2] < before]
        last = folders[-fan:]
        if len(last) < fan or len({level for level, _, _ in last}) > 1:
            return
        rows = merge(read_log(spark, path, schema, last))
        rows.write.mode("overwrite").parquet(
            f"{path}-merged/{last[0][0] + 1}-{last[0][1]}-{last[-1][2]}")


def newest_rows(log: DataFrame, key: str, *newest_by: str) -> DataFrame:
    """Of each key the row with the greatest `newest_by`, with its batch; combined before the shuffle."""
    others = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*newest_by)).alias("_row"))
    return best.select(key, "_row.*")


def current_rows(log: DataFrame, key: str, *newest_by: str) -> DataFrame:
    """Of each key the row with the greatest `newest_by`; combined before the shuffle."""
    others = [c for c in log.columns if c not in (key, "batch_id")]
    order = F.struct(*newest_by)
    best = log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return best.select(key, "_row.*")
