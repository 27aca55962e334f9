"""A folder of statement files as a stream: each content is imported once.

Which contents have been seen is keyed state of the stream (in RocksDB, one small entry per content,
kept by its checkpoint), so a batch compares its files with the state of their own hashes and
never reads the registry.  Ids continue from one number that the batch before left behind.
A batch costs what it brings, the thousandth like the first.  It is one job, which asks and commits its
state once, numbers the new rows and writes them; the state lies in a fixed number of partitions, each
commit writing only what changed.  Only rows of more than a block of files are written before they are
numbered, by several tasks.
"""

import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pennywright.operators.windows import BLOCK, dense_ids
from pennywright.streaming.batches import read_batches, write_batch

REGISTRY = "id long, file_hash string, original_path string, filename string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of a stream while it starts and lists its folder.  The partitions stay those of its checkpoint.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.shuffle.partitions": "12",
    # each batch has other literals (its time, the last id), so its code would be compiled anew for
    # a few rows, on the driver and on each executor
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    # a folder is listed by as many tasks at most, not by one for each folder in it
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # every batch lists the log of the files read, which holds the batches of ten minutes otherwise
    "spark.sql.streaming.fileSource.log.cleanupDelay": "30s",
}
MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
#: Also for a checkpoint in a local folder, where the session does not name them.  Both managers write a
#: file beside and rename it, but the usual one starts eight processes for that (readlink of both ends);
#: the local file system has checksums of its own beside every file.
LOCAL = {
    MANAGER: "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
FOUND = "file_hash string, original_path string, filename string"
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files with their hash; the bytes do not leave the scan."""
    files = (
        spark.readStream.format("binaryFile").schema(_BINARY)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return files.select(
        F.sha2("content", 256).alias("file_hash"),
        F.col("path").alias("original_path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
    )


def unseen_files(files: DataFrame) -> DataFrame:
    """Contents met in a batch, in update mode: those that are new have `is_new`, with their first path.

    Batch times rise, so a content is new in the batch that is both its first and its last.  Copies
    are combined before they are shuffled.
    """
    timed = files.withColumn("at", F.current_timestamp())  # of the batch, the same when it runs again
    met = timed.groupBy("file_hash").agg(
        F.min(F.struct("at", "original_path")).alias("first"), F.max("at").alias("last"))
    return met.select("file_hash", F.col("first.original_path").alias("original_path"),
                      F.element_at(F.split("first.original_path", "/"), -1).alias("filename"),
                      (F.col("first.at") == F.col("last")).alias("is_new"))


class Notes:
    """The greatest id after each batch, in one small file a batch, written and read by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.last = spark, path, {}
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, batch_id: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={batch_id}")

    def read(self, batch_id: int) -> int:
        if batch_id in self.last:
            return self.last[batch_id]
        path = self._of(batch_id)
        if self.fs.isDirectory(path):  # of a checkpoint whose notes were tables
            return self.spark.read.schema("last long").parquet(path.toString()).first().last
        note = self.fs.open(path)
        try:
            return note.readLong()
        finally:
            note.close()

    def write(self, batch_id: int, last: int) -> None:
        """Only a batch whose note is closed ends, and one that runs again writes its note again."""
        path = self._of(batch_id)
        if not self.last and self.fs.isDirectory(path):  # only the first batch of a run may run again
            self.fs.delete(path, True)
        note = self.fs.create(path, True)
        try:
            note.writeLong(last)
        finally:
            note.close()
        self.last = {batch_id: last}


def _last_id(spark: SparkSession, notes: Notes, registry: str, batch_id: int) -> int:
    """The greatest id before a batch: what the batch before noted, at the start the registry's."""
    if batch_id > 0:
        return notes.read(batch_id - 1)
    return read_batches(spark, registry, REGISTRY, 0).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def import_folder(spark: SparkSession, folder: str, registry: str, checkpoint: str,
                  files_per_batch: int = 1000) -> StreamingQuery:
    """Register files whose content is new, whatever their names; ids continue.

    The state belongs to the checkpoint: with a new one for an old registry all files are new.
    """
    notes, found = Notes(spark, f"{checkpoint.rstrip('/')}-ids"), f"{checkpoint.rstrip('/')}-found"

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        start = _last_id(session, notes, registry, batch_id)
        if files_per_batch > BLOCK:  # numbering reads its rows more than once, and would ask the state each time
            write_batch(batch, found, batch_id)
            batch = session.read.schema(FOUND).parquet(f"{found}/batch_id={batch_id}")
        written = Observation()  # by the tasks that write, each counted once
        write_batch(dense_ids(batch, "file_hash", start, most=files_per_batch).select(
            "id", "file_hash", "original_path", "filename").observe(
            written, F.count(F.lit(1)).alias("n")), registry, batch_id)
        notes.write(batch_id, start + written.get["n"])

    settings = dict(SETTINGS)
    if notes.fs.getUri().getScheme() == "file":
        settings.update((k, v) for k, v in LOCAL.items() if spark.conf.get(k, None) is None)
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:  # a query takes the settings of its session when it starts, its source when it is made after that
        met = unseen_files(file_stream(spark, folder, files_per_batch))
        query = (
            met.filter("is_new").drop("is_new").writeStream.outputMode("update").foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        while query.isActive and query.status["message"].startswith("Initializing"):
            time.sleep(0.05)
        return query
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
