"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Every document gets the set of filters that it fails.  Per part and range of ids, each filter
then has a sorted posting list of its failing documents.  What a filter removes after others is
the difference of its list and the union of theirs; both come from merges of the sorted lists that
gallop from one range of ids to the next and touch only lists with entries there.  Sizes of the
ranges add up, so no task holds a part and the hottest part is spread over many ranges.

Defined results:
* a null text counts as empty; a null part as the empty string;
* rows that are alike (id, part, text) are counted once each, but stored as one with a weight;
* a row without an id is never a copy of another nor the first of its copies, and has no label;
* rows of one id with different texts are judged one by one; several labels of one id count
  as lost if any of them is 1; labels without a document are ignored;
* an empty table has no parts and so no rows.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pennywright.llm.shared import words_of, written

#: Failure conditions by letter, over text (never null), n_words and n_distinct, in the order of
#: the bits of `fails`.  COPIES is the one that needs the whole table.
CONDITIONS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * (n_chars - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * n_chars",
    "D": "text RLIKE '[#$%&*|]'",
}
COPIES = "E"
RANGE = 16_384  # documents in a range of ids
BLOCK = 64 * RANGE  # documents that a task holds at once


def gallop(ids: np.ndarray, value: int, at: int) -> int:
    """The first place from `at` on whose id is at least `value`, by doubling steps."""
    step, end = 1, len(ids)
    if at >= end or ids[at] >= value:
        return at
    while at + step < end and ids[at + step] < value:
        at, step = at + step, 2 * step
    return at + 1 + int(np.searchsorted(ids[at + 1: at + step], value))


def _ranges(lists: list[np.ndarray], width: int):
    """Slices of sorted lists by range of ids, from one range with entries to the next."""
    at = [0] * len(lists)
    while True:
        heads = [int(x[i]) for x, i in zip(lists, at) if i < len(x)]
        if not heads:
            return
        stop = min(heads) // width * width + width
        ends = [gallop(x, stop, i) for x, i in zip(lists, at)]
        yield [x[i:j] for x, i, j in zip(lists, at, ends)]
        at = ends


def union(lists: list[np.ndarray], width: int = RANGE) -> np.ndarray:
    """Ids of any of the sorted lists, sorted, each once."""
    out = []
    for slices in _ranges(lists, width):
        some = [s for s in slices if len(s)]
        out.append(some[0] if len(some) == 1 else np.unique(np.concatenate(some)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def difference(left: np.ndarray, right: np.ndarray, width: int = RANGE) -> np.ndarray:
    """Ids of `left` that are not in `right`; both sorted."""
    out = []
    for a, b in _ranges([left, right], width):
        if not len(b):
            out.append(a)
        elif len(a):
            place = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out.append(a[b[place] != a])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def range_counts(fails: np.ndarray, weights: np.ndarray, filters: int) -> list[tuple]:
    """(earlier filters as bits, filter, kept, removed, redundant, good lost, toxic lost).

    `fails` holds the failed filters of documents in order of their ids, `weights` their number and
    those of them labelled good and toxic.  Places in that order are the ids of the postings.
    """
    lists = [np.flatnonzero(fails >> f & 1) for f in range(filters)]
    unions = {0: np.zeros(0, np.int64)}
    for chosen in range(1, 1 << filters):
        unions[chosen] = union([lists[f] for f in range(filters) if chosen >> f & 1])
    total = weights[:, 0].sum()
    failed = [weights[x, 0].sum() for x in lists]
    gone = {chosen: weights[u, 0].sum() for chosen, u in unions.items()}
    out = []
    for earlier, f in itertools.product(range(1 << filters), range(filters)):
        if not earlier >> f & 1:
            removed, good, toxic = weights[difference(lists[f], unions[earlier])].sum(axis=0).tolist()
            out.append((earlier, f, int(total - gone[earlier | 1 << f]), removed,
                        int(failed[f] - removed), good, toxic))
    return out


def failures(docs: DataFrame, labels: DataFrame, part: Column,
             conditions: dict[str, str] = CONDITIONS) -> DataFrame:
    """part, doc_id, fails (bits), n, good, toxic: what the documents fail, alike rows as one."""
    ws = words_of(F.col("text"))
    texts = docs.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"), "doc_id",
        F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("words", ws).select(
        "part", "doc_id", "text", F.length("text").alias("n_chars"), F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"))
    bits = sum((F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(conditions.values())),
               F.lit(0))
    rows = texts.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("key"),
                        bits.cast("int").alias("fails"))
    rows = written(rows.groupBy("part", "doc_id", "key", "fails").agg(
        F.count(F.lit(1)).alias("n")), "audit-rows")
    # copies are combined before they are shuffled; the first of each text is found by its id, so
    # that a text with very many copies is no hot key of a join
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts.withColumn("first", F.lit(True)), ["doc_id", "key"], "left").join(
        known, "doc_id", "left").select(
        "part", "doc_id", (F.col("fails") + F.when(copy, 1 << len(conditions)).otherwise(0)).alias("fails"),
        "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _sizes(filters: int, block: int):
    """Task over documents sorted by part and id: counts of every range of ids of a part."""
    schema = pa.schema([("part", pa.string()), ("earlier", pa.int32()), ("filter", pa.int32()),
                        *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "good", "toxic")]])

    def counted(part, held):
        fails = np.concatenate([f for f, _ in held])
        rows = range_counts(fails, np.concatenate([w for _, w in held]), filters)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.string()),
             *[pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:])]], schema=schema)

    def run(batches):
        part, held, size = None, [], 0
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            fails = batch.column("fails").to_numpy()
            weights = np.stack([batch.column(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
            cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
            for i, j in zip([0, *cuts], [*cuts, len(parts)]):
                if i == j:
                    continue
                if held and (parts[i] != part or size >= block):
                    yield counted(part, held)
                    held, size = [], 0
                part = parts[i]
                held.append((fails[i:j], weights[i:j]))
                size += j - i
        if held:
            yield counted(part, held)

    return run


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """filter_order, step, earlier, filter of every order of the letters."""
    rows = []
    for order in itertools.permutations(range(len(letters))):
        for step, f in enumerate(order):
            rows.append(("".join(letters[i] for i in order), step + 1,
                         sum(1 << i for i in order[:step]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, earlier int, filter int")


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None,
          conditions: dict[str, str] = CONDITIONS, block: int = BLOCK) -> DataFrame:
    """One row per part, order of the filters and step.

    With k filters there are k * k! rows per part, and 2^k unions per range of ids, so this is
    for short chains.
    """
    spark = docs.sparkSession
    letters = "".join(conditions) + COPIES
    k = len(letters)
    rows = written(failures(docs, labels, F.col("lang") if part is None else part, conditions),
                   "audit-failures")
    # ranges are cut by counts: a third of the rows in one part makes more ranges, not a larger one
    ranged = rows.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    sums = ranged.mapInArrow(
        _sizes(k, block), "part string, earlier int, filter int, kept long, removed long, "
                          "redundant long, good long, toxic long").groupBy("part", "earlier", "filter").agg(
        *[F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "good", "toxic")])
    # of the orders of all filters, those that put exactly `earlier` before `filter`
    times = F.element_at(F.array(*[
        F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)]),
        F.bit_count("earlier") + 1)
    sums = written(sums.withColumn("times", times), "audit-sums")
    rest = F.col("earlier") == F.expr(f"{(1 << k) - 1} - shiftleft(1, `filter`)")
    whole = sums.groupBy("part", "filter").agg(
        F.max(F.when(rest, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    # at most k * k! rows
    out = sums.join(F.broadcast(orders(spark, letters)), ["earlier", "filter"]).join(whole, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
