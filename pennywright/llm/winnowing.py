"""Document fingerprints by winnowing, DataFrame functions only.

Words are hashed; K consecutive word hashes make a k-gram hash (a rolling cyclic polynomial:
rotate and xor).  Of every window of W consecutive k-grams the least hash is
selected, the rightmost on ties, with its position.  Two texts that share a run of
K + W - 1 words therefore share a selected hash.  A text of fewer than K words is one
k-gram; a text of fewer than W k-grams is one window.

Both the polynomial and the window minimum are built by doubling: a pass over an
array combines each entry with the one 1, 2 or 4 places on, so W entries cost
log2(W) passes instead of W comparisons.  A selected entry is one number, hash
in the high 31 bits and the complement of its position in the low 32, so that
`least` picks the least hash and on ties the greatest position.

Scale: a text is fingerprinted where it is read.  Only `with_next`, which needs the
neighbour in doc_id order, shuffles texts, once: rows go to ranges of doc_id, and
the first row of each range is added behind the range before it.

Defined results: a null text is empty; a text without words has an empty
fingerprint, and two empty ones have likeness 1.  Repeated rows are fingerprinted
each; rows of one doc_id order by text, null doc_ids come first.  An empty table gives
no rows.  Other columns are left out; working columns are named `__wn_...`.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pennywright.llm.shared import words_of

K = 4  # words per k-gram; a power of two
W = 8  # k-grams per window; a power of two
RANGE_ROWS = 512  # documents per range of doc_id, while there are at most MOST_RANGES
MOST_RANGES = 65_536
LOW = 0xFFFFFFFF


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def fingerprints(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add {prefix}_selected (packed, in order of position) and {prefix}_hashes (distinct).

    The steps are columns of their own, so that none is written out twice.
    """
    def col(name):
        return F.col(f"__wn_{prefix}_{name}")

    def step(frame, name, value):
        return frame.withColumn(f"__wn_{prefix}_{name}", value)

    before = df.columns
    df = step(df, "words", words_of(F.col(text)))
    df = step(df, "g0", F.transform(col("words"), lambda w: F.xxhash64(w)))
    span, last = 1, "g0"
    while span < K:  # entry i covers words i .. i + 2 * span - 1; missing ones count as 0
        name, old, width = f"g{span}", col(last), span
        df = step(df, name, F.transform(old, lambda x, i: _rotated(x, width).bitwiseXOR(
            F.coalesce(F.get(old, i + width), F.lit(0)))))
        span, last = span * 2, name
    n = F.size(col(last))
    grams = F.slice(col(last), 1, F.greatest(n - (K - 1), F.least(n, F.lit(1))))
    df = step(df, "m0", F.transform(grams, lambda g, i: F.shiftleft(
        g.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.lit(LOW) - i)))
    span, last = 1, "m0"
    while span < W:
        name, old, width = f"m{span}", col(last), span
        df = step(df, name, F.transform(
            old, lambda x, i: F.least(x, F.coalesce(F.get(old, i + width), x))))
        span, last = span * 2, name
    n = F.size(col(last))
    windows = F.slice(col(last), 1, F.greatest(n - (W - 1), F.least(n, F.lit(1))))
    df = step(df, "kept", F.array_distinct(windows))
    return df.select(
        *before, col("kept").alias(f"{prefix}_selected"),
        F.array_distinct(F.transform(col("kept"), lambda x: F.shiftright(x, 32)))
        .alias(f"{prefix}_hashes"),
    )


def unpacked(selected: Column) -> Column:
    """Selected entries as structs of hash and position (the k-gram's first word, from 0)."""
    return F.transform(selected, lambda x: F.struct(
        F.shiftright(x, 32).alias("hash"),
        (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).alias("position")))


def digest(selected: Column) -> Column:
    """One string for a fingerprint with its positions."""
    return F.md5(F.array_join(selected.cast("array<string>"), " "))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def winnow(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (array of hash and position), one row per row of `docs`."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__wn_text"))
    df = fingerprints(df, "__wn_text", "fp")
    return df.select("doc_id", unpacked(F.col("fp_selected")).alias("fingerprint"))


def _ranges(ids: DataFrame) -> tuple[Column, DataFrame]:
    """The range of a doc_id, and the ranges in use with the one that follows each."""
    seen = ids.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                   F.count(F.lit(1)).alias("n")).first()
    lo, hi = seen.lo or 0, seen.hi or 0
    wanted = max(1, min(MOST_RANGES, -(-seen.n // RANGE_ROWS)))
    width = (hi - lo) // wanted + 1
    at = F.coalesce(F.expr(f"(doc_id - {lo}L) div {width}L"), F.lit(-1).cast("long"))
    used = ids.select("doc_id", at.alias("__wn_range")).groupBy("__wn_range").agg(
        F.min("doc_id").alias("__wn_first"))
    # at most MOST_RANGES + 1 rows; the first range follows the last
    order = Window.partitionBy(F.lit(0)).orderBy("__wn_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used = used.withColumn("__wn_before", F.coalesce(
        F.lag("__wn_range").over(order), F.last("__wn_range").over(whole)))
    return at, used


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp_selected, fp_hashes, and next_text, next_hashes of the next document.

    The next document is that of the next greater doc_id; after the last comes the first.
    """
    at, used = _ranges(docs.select("doc_id"))
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprints(df.withColumn("__wn_range", at), "text", "fp").withColumn(
        "__wn_extra", F.lit(0))
    # the first document of each range once more, behind the range before
    # at most MOST_RANGES + 1 rows of three numbers, so that no text is shuffled for them
    heads = df.withColumn("__wn_at", at).join(
        F.broadcast(used), F.col("__wn_at").eqNullSafe(F.col("__wn_range"))
        & F.col("doc_id").eqNullSafe(F.col("__wn_first")))
    heads = heads.groupBy("__wn_before").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast(df.schema["doc_id"].dataType).alias("doc_id"), "text",
                         F.col("__wn_before").alias("__wn_range"))
    heads = fingerprints(heads, "text", "fp").withColumn("__wn_extra", F.lit(1))
    order = Window.partitionBy("__wn_range").orderBy("__wn_extra", "doc_id", "text")
    return rows.unionByName(heads).withColumns({
        "next_text": F.lead("text").over(order),
        "next_hashes": F.lead("fp_hashes").over(order),
    }).filter("__wn_extra = 0").drop("__wn_range", "__wn_extra")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, with likenesses.

    In the edited text the last half of the characters (rounded down) is replaced by
    as many first characters of the next document, or all it has.
    """
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    df = with_next(docs).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), n - half),
        F.substring(F.col("next_text"), F.lit(1), half)))
    df = df.select(
        "doc_id", n.cast("long").alias("n_chars"), "edited", "fp_hashes",
        digest(F.col("fp_selected")).alias("fingerprint"),
        likeness(F.col("fp_hashes"), F.col("next_hashes")).alias("near_next"))
    df = fingerprints(df, "edited", "ed")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint",
        digest(F.col("ed_selected")).alias("edited_fingerprint"),
        likeness(F.col("fp_hashes"), F.col("ed_hashes")).alias("near_edited"), "near_next")
