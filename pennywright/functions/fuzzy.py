"""Best partial match of a text among a fixed list of aliases.

The score of two strings is the best similarity 100 * 2 * LCS / (len + len) of
the shorter one against any window of the longer one (windows of the shorter
length, and the shorter windows at both ends).  It is the one function here
that columns cannot express, so it runs in Python on distinct texts only (as Arrow batches), and only
for the few aliases that share enough letter pairs with a text (`AliasIndex`).
"""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pennywright.functions.matching import once

MATCH = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("score", T.DoubleType())])


def _lcs(masks: dict, full: int, window: str) -> int:
    """Longest common subsequence of a pattern (as bit masks) and a window."""
    rest = full
    for ch in window:
        both = rest & masks.get(ch, 0)
        rest = ((rest + both) | (rest - both)) & full
    return (full ^ rest).bit_count()


def _scan(short: str, long: str, best: float) -> float:
    """Best window score above `best`, else `best`."""
    m, n = len(short), len(long)
    masks: dict = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << m) - 1
    left = Counter(short)
    shared = 0
    for end in range(1, n + m):
        # the window is long[end - m:end] cut to the text; slide by one character
        if end <= n:
            ch = long[end - 1]
            if ch in left:
                shared += left[ch] > 0
                left[ch] -= 1
        if end > m:
            ch = long[end - m - 1]
            if ch in left:
                left[ch] += 1
                shared -= left[ch] > 0
        start, stop = max(0, end - m), min(end, n)
        size = m + stop - start
        if 200.0 * shared / size > best:
            score = 200.0 * _lcs(masks, full, long[start:stop]) / size
            if score > best:
                best = score
                if best == 100.0:
                    return best
    return best


def partial_ratio(a: str, b: str, floor: float = -1.0) -> float:
    """Score of two strings, or `floor` when it is not above it."""
    if not a or not b:
        return max(floor, 100.0 if a == b else 0.0)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _scan(short, long, floor)
    if len(a) == len(b) and best < 100.0:
        best = _scan(long, short, best)
    return best


def least_shared(m: int, threshold: float) -> int:
    """Pairs of neighbouring letters that a string of length m shares with any partner, at least.

    A match of `threshold` with a window of w letters keeps L >= threshold / 200 * (m + w)
    letters in order.  Of the m - 1 pairs, a letter left out takes two along, and a letter of the
    window in between takes one.
    """
    least = m - 1
    for w in range(1, m + 1):
        kept = math.ceil(threshold * (m + w) / 200.0 - 1e-9)
        if kept <= w:
            least = min(least, m - 1 - 2 * (m - kept) - (w - kept))
    return least


class AliasIndex:
    """Which aliases can match a text at all, found from pairs of letters with array functions.

    Buckets of letter pairs list the aliases that hold such a pair.  The buckets that a text's own
    pairs fall in count the shared pairs (or more, as pairs of one bucket look alike), and only
    aliases that reach `least_shared` stay.  No alias that would match is lost.
    """

    BUCKETS = 1024

    def __init__(self, aliases, threshold: float = 75.0):
        self.aliases, self.threshold = list(aliases), threshold
        self.buckets: list[list[int]] = [[] for _ in range(self.BUCKETS)]
        for position, alias in enumerate(self.aliases):
            for a, b in zip(alias, alias[1:]):
                self.buckets[(31 * ord(a) + ord(b)) % self.BUCKETS].append(position)
        longest = max(map(len, self.aliases), default=0)
        self.least = [least_shared(m, threshold) for m in range(longest + 1)]

    def candidates(self, text: Column) -> Column:
        """Positions of the aliases that may match, rising; null for null."""
        def numbers(values):
            return f"array({', '.join(map(str, values))})"

        buckets = F.expr(f"CAST(array({', '.join(map(numbers, self.buckets))}) AS array<array<int>>)")
        lengths, least = F.expr(numbers(map(len, self.aliases))), F.expr(numbers(self.least))
        everyone = F.sequence(F.lit(0), F.lit(len(self.aliases) - 1))
        longest = len(self.least) - 1
        # lengths at which nothing is certain to be shared
        open_to_all = [m for m, n in enumerate(self.least) if n <= 0]

        def needed(position, length):
            return F.get(least, F.least(length, F.get(lengths, position)))

        def of_codes(codes):
            pairs = F.slice(F.zip_with(codes, F.slice(codes, 2, F.size(codes)),
                                       lambda a, b: F.get(buckets, F.pmod(31 * a + b, F.lit(self.BUCKETS)))),
                            1, F.greatest(F.size(codes) - 1, F.lit(0)))
            length = F.size(codes)

            def counted(hits):
                return F.filter(hits, lambda p, i: p == F.get(
                    hits, i + F.greatest(needed(p, length), F.lit(1)) - 1))

            found = F.array_distinct(once(F.sort_array(F.flatten(pairs)), counted))
            free = F.filter(everyone, lambda p: needed(p, length) <= 0)
            some_free = F.least(length, F.lit(longest)).isin(open_to_all) if open_to_all else F.lit(False)
            if any(len(a) in open_to_all for a in self.aliases):
                some_free = F.lit(True)
            return F.when(some_free, F.sort_array(F.array_union(free, found))).otherwise(found)

        if not self.aliases:
            return F.when(text.isNotNull(), F.array().cast("array<int>"))
        codes = F.filter(F.transform(F.split(text, ""), F.ascii), lambda c: c > 0)
        return F.when(text.isNotNull(), once(codes, of_codes))


def best_alias(text: str, aliases, threshold: float, positions=None):
    """(position, score) of the first best alias at or above `threshold`, of those at `positions`."""
    found, best = None, threshold - 1e-9
    for position in range(len(aliases)) if positions is None else positions:
        score = partial_ratio(text, aliases[position], best)
        if score > best:
            found, best = position, score
            if best == 100.0:
                break
    return (found, best) if found is not None else (None, None)


def with_best_alias(df: DataFrame, text: str, name: str, aliases, threshold: float = 75.0) -> DataFrame:
    """Add column `name`, struct(position, score) of the best alias of column `text`; nulls without.

    The index finds the aliases worth scoring natively; texts without any are not scored.
    """
    index = AliasIndex(aliases, threshold)
    aliases = index.aliases

    def match(batches):
        for batch in batches:
            known: dict = {}
            found = []
            for t, some in zip(batch.column(text).to_pylist(), batch.column("_candidates").to_pylist()):
                if t not in known:
                    known[t] = best_alias(t, aliases, threshold, some) if some else (None, None)
                found.append(known[t])
            best = pa.StructArray.from_arrays(
                [pa.array([p for p, _ in found], pa.int32()), pa.array([s for _, s in found], pa.float64())],
                ["position", "score"])
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_candidates"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), best],
                                             [*(batch.schema.names[i] for i in kept), name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, MATCH)])
    return df.withColumn("_candidates", index.candidates(F.col(text))).mapInArrow(match, schema)
