"""A training corpus from documents: filter, deduplicate, cut repeats, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a frame; `run` writes each one's result
to the shared folder and reads it back as the next one's documents.  All but the last keep the
columns of documents.
"""

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pennywright.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from pennywright.llm.shared import table, written

TOKENIZER = "word_bpe_49k.json"
MIX_FRACTION = (9, 10)  # of the tokens that reach the mixing stage
MIX_EPOCHS = 1
#: Bytes of the batches that Spark hands to Python.  Its 10,000 rows are no bound: with texts of 3 kB
#: both sides of each task would hold 33 MB, more with longer ones.
BATCH_BYTES = 4_000_000


def bounded(stage):
    """The stage, with batches of BATCH_BYTES in the session that runs it."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_documents(docs)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group: five words, similarity 0.8."""
    return ngram_join.keep_first(docs, n=5, num=80, den=100)


@bounded
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that stand earlier."""
    return suffix_dedup.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, shared by the weights of domains, languages and sources."""
    return mixing.select_documents(docs, MIX_FRACTION, MIX_EPOCHS)


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), ids=False)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]

#: Tokenizing and byte-level removal are beyond SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
