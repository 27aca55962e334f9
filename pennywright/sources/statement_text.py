"""Statement text: files -> pages -> lines, and the bank format of each file."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.matching import matches_any
from pennywright.functions.text import strip

BREAK = r"\r\n|\n|\r"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: original_path, filename, content, file_hash."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("original_path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        decoded(F.col("content")).alias("content"),
        F.sha2("content", 256).alias("file_hash"),
    )


def decoded(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1 (which takes any byte)."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def bank_format(filename: Column, content: Column) -> Column:
    """boa / dcu by file name, chase by first-page marks, else dcu."""
    name = F.lower(filename)
    first = F.substring_index(content, "\f", 1)
    is_chase = first.contains("JPMorgan Chase") | F.lower(first).contains(fv.CHASE_START)
    return (
        F.when(name.startswith("estmt_"), "boa")
        .when(name.startswith("stmt_"), "dcu")
        .when(is_chase, "chase")
        .otherwise("dcu")
    )


def kept_pages(content: Column, fmt: Column) -> Column:
    """Content without its legal pages (pages end at a form feed).

    A boa page also stays when it has section words; other formats keep all.
    """
    def keep(page):
        dcu = ~page.rlike(fv.DCU_BOILERPLATE)
        words = page.contains(fv.BOA_KEEP_WORDS[0]) | page.contains(fv.BOA_KEEP_WORDS[1])
        boa = ~page.rlike(fv.BOA_BOILERPLATE) | words
        return F.when(fmt == "dcu", dcu).when(fmt == "boa", boa).otherwise(F.lit(True))

    return F.array_join(F.filter(F.split(content, "\f"), keep), "\n")


def with_format(files: DataFrame) -> DataFrame:
    """Add bank_fmt and drop the pages that format ignores."""
    marked = files.withColumn("bank_fmt", bank_format(F.col("filename"), F.col("content")))
    return marked.withColumn("content", kept_pages(F.col("content"), F.col("bank_fmt")))


def to_lines(files: DataFrame, keys=("file_id",)) -> DataFrame:
    """One row per non-blank line: keys, line_no (from 0), stripped line."""
    lines = files.select(
        *keys, F.posexplode(F.split("content", BREAK)).alias("line_no", "line")
    )
    return lines.withColumns(
        {"line_no": F.col("line_no").cast("long"), "line": strip(F.col("line"))}
    ).filter("line <> ''")


def is_noise(line: Column, holder_names=()) -> Column:
    """Column headers, sub-totals and card-holder lines inside a section."""
    names = [rf"^{n}\s+#" for n in holder_names]
    return matches_any(line, fv.SECTION_NOISE + names, ignore_case=True)
