"""Removal of long repeated passages by run-length compressed suffix indexes, exact to the byte.

A byte goes if it is covered by a string of WIDTH bytes that also starts earlier: in a
document of smaller id, or earlier in the same document.

1. Every window of WIDTH bytes has an anchor, the least hash of its K-byte substrings; equal
   windows have equal anchors.  Consecutive windows with one anchor form a context, some
   140 bytes for some 40 windows.
2. Anchors that occur in one text only, once, cannot repeat and are left out.  Contexts of
   the others are dealt by anchor, so that all occurrences of a window meet in one task.
3. A task goes through its anchors in batches of whole anchors.  Distinct contexts that agree
   with no other of their anchor in half of what a window has before it, or after it, share no
   window and are left out.  Of the others of a batch it builds a run-length index: the Burrows-Wheeler transform of the contexts, kept as
   runs with the LF mapping of each run's start, text positions sampled at run ends, and
   the rank intervals of strings of WIDTH bytes.  The contexts are then streamed through the
   index backwards, all at once: each LF step gives the rank of the next suffix, its interval
   tells which of its matches reach WIDTH (the matching statistic, as far as it matters
   here), and windows whose interval an earlier one has opened are marked.  A sampled run
   end that the walk meets must show the walk's position.
4. Marks of a document are united to spans.

Copies of a whole text are found by a hash of the text and need no contexts: all bytes of
the later ones go, if there are WIDTH.

Scale: the texts are shuffled once, by id, for two joins in one plan; anchors as
pairs of numbers.  A task holds the distinct contexts of one batch.  Anchors with more than
`hot` texts are dealt window by window by a hash of the window's bytes, so that no group of
contexts is large; this gives the same marks.

Defined results: a null text is empty; a null doc_id comes after all others; repeated rows of
one id and text are one document and don't repeat each other; texts shorter than WIDTH
stay whole; an empty table gives no rows.  `remove_repeats` keeps the columns of its
input, whatever their names; working columns are named `__sd_...`.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pennywright.llm.shared import written

WIDTH = 100  # bytes of a string that counts as repeated
K = 16  # bytes of an anchor; a power of two
CHUNK = 1 << 19  # window starts handled at once
PLACES = 1 << 20  # more than the bytes of a chunk
LONGEST = 4096  # windows of a context
BATCH = 400_000  # bytes of distinct contexts per index, which takes some 130 times that while it is made
HOT = 20_000  # texts of an anchor
DEEP = 4  # symbols in a first sort key


# ---- anchors ----------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _anchors_of(data: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window and its place, the leftmost on ties."""
    h, base, span = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while span < k:
        h = h[:-span] * np.uint64(base) + h[span:]
        base, span = base * base % 2**64, span * 2
    h = _mixed(h)
    low = np.uint64(PLACES - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    left, span = width - k + 1, 1
    while span * 2 <= left:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = left - span
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    place = (least & low).astype(np.int64)
    return h[place], place


def contexts_of(data: bytes, width: int = WIDTH, k: int = K):
    """(anchor, first window, number of windows, again, at) of the contexts of a text, as arrays.

    again: windows of the context may be equal to each other; then the anchor is met at
    several places.  at: the first of these, in bytes from the first window.
    """
    found = []
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(data) - width + 1, 0), CHUNK):
        anchors, place = _anchors_of(raw[at: at + CHUNK + width - 1], width, k)
        n = len(anchors)
        first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
        size = np.diff(np.append(first, n))
        if size.max() > LONGEST:
            first = np.concatenate([np.arange(f, f + s, LONGEST) for f, s in zip(first, size)])
            size = np.diff(np.append(first, n))
        again = place[first] != place[first + size - 1]
        found.append((anchors[first], first + at, size, again, place[first] - first))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool), none
    return tuple(np.concatenate(x) for x in zip(*found))


# ---- run-length index -------------------------------------------------------------------


def _ranked(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Ranks from 1 by the pair (high, low < 2**bits), equal pairs alike, and how many there are.

    Where pair and place fit into 63 bits they are sorted as one number, which is several
    times faster than sorting places by a key.
    """
    n = len(high)
    places = n.bit_length()
    if int(high.max()).bit_length() + bits + places <= 63:
        packed = np.sort((high << (bits + places)) | (low << places) | np.arange(n))
        order = packed & ((1 << places) - 1)
        ordered = packed >> places
        step = ordered[1:] != ordered[:-1]
    else:
        order = np.lexsort((low, high))
        step = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    total = np.ones(n, np.int64)
    np.cumsum(step, out=total[1:])
    total[1:] += 1
    rank = np.empty(n, np.int64)
    rank[order] = total
    return rank, int(total[-1])


class RunIndex:
    """Burrows-Wheeler transform of several strings as runs.

    Each string ends with a terminator of its own, smaller than all bytes and ordered as the
    strings are, so that ranks 0, 1, ... are the strings' ends.
    """

    def __init__(self, strings: list[bytes], width: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.sizes, self.width = sizes, width
        n = int(sizes.sum()) + len(strings)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n + DEEP, np.int64)
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        text[:n] = raw
        text[:n] += 1
        text[ends] = 0
        string = np.repeat(np.arange(len(strings)), sizes + 1)
        left = ends[string] - np.arange(n)  # symbols before the terminator
        where = np.arange(n)
        key = np.zeros(n, np.int64)
        for t in range(DEEP):
            key = (key << 9) | np.where(left >= t, text[t: n + t], 0)
        rank, groups = _ranked(key, np.zeros(n, np.int64), 0)
        bits = n.bit_length()
        depth, half = DEEP, rank
        half_depth = DEEP
        while groups < n and depth <= int(sizes.max()):
            behind = np.where(left >= depth, rank[np.minimum(where + depth, n - 1)], 0)
            rank, groups = _ranked(rank, behind, bits)
            depth *= 2
            if depth <= width:
                half, half_depth = rank, depth
        last, _ = _ranked(rank, string, bits)  # equal suffixes by the order of their strings
        order = np.empty(n, np.int64)
        order[last - 1] = where
        # intervals of suffixes that share their first `width` symbols
        rest = half[np.minimum(where + width - half_depth, n - 1)]
        same = (half * (n + 2) + rest)[order]
        whole = (left >= width)[order]
        opens = np.ones(n, bool)
        opens[1:] = (same[1:] != same[:-1]) | ~whole[1:] | ~whole[:-1]
        before = np.zeros(n, np.int64)
        before[1:] = text[: n - 1]
        symbol = before[order]  # 0, a terminator, before the start of a string
        heads = np.r_[True, symbol[1:] != symbol[:-1]]
        self.run_of = np.cumsum(heads, dtype=np.int32) - 1  # rank support of the run heads
        self.interval_of = np.cumsum(opens, dtype=np.int32) - 1
        self.run_starts = np.flatnonzero(heads)
        run_symbol = symbol[self.run_starts]
        run_size = np.diff(np.append(self.run_starts, n))
        by_symbol = np.argsort(run_symbol, kind="stable")
        self.run_targets = np.empty(len(run_size), np.int64)
        self.run_targets[by_symbol] = np.cumsum(run_size[by_symbol]) - run_size[by_symbol]
        self.run_ends = self.run_starts + run_size - 1
        self.samples = order[self.run_ends]
        self.ends = ends

    def step(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes one symbol longer, and the runs they were in."""
        run = self.run_of[rank]
        return self.run_targets[run] + rank - self.run_starts[run], run

    def stream(self):
        """(interval, string, start) of every window of every string, walking from the ends."""
        by_size = np.argsort(-self.sizes, kind="stable")
        rank = by_size.copy()  # a string's end has the string's own rank
        sizes = self.sizes[by_size]
        for done in range(1, int(sizes[0]) + 1):
            active = int(np.searchsorted(-sizes, -done, "right"))
            at = rank[:active]
            moved, run = self.step(at)
            met = np.flatnonzero(self.run_ends[run] == at)
            position = self.ends[by_size[met]] - done + 1
            if (self.samples[run[met]] != position).any():
                raise RuntimeError("walk and samples of a run-length index differ")
            rank = moved
            by_size, sizes = by_size[:active], sizes[:active]
            if done >= self.width:
                yield self.interval_of[rank], by_size, sizes - done


def repeated_windows(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, which of its windows also start earlier in it or in a string before."""
    index = RunIndex(strings, width)
    parts = [np.concatenate(x) for x in zip(*index.stream())]
    if not parts:
        return [np.zeros(0, bool) for _ in strings]
    interval, string, start = parts
    place = string * (1 << 32) + start
    first = np.full(int(index.interval_of[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, interval, place)
    again = place > first[interval]
    out = [np.zeros(max(len(s) - width + 1, 0), bool) for s in strings]
    offset = np.cumsum([0] + [len(o) for o in out])
    flat = np.zeros(offset[-1], bool)
    flat[offset[string] + start] = again
    return [flat[a:b] for a, b in zip(offset, offset[1:])]


def runs_of(flags: np.ndarray):
    """(first, length) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


# ---- on Spark ---------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """__sd_id (nulls last), __sd_key (hash of the text) and __sd_text of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__sd_id"),
        F.xxhash64(text).alias("__sd_key"), text.alias("__sd_text"))


def _anchor_rows(keyed: DataFrame, width: int, k: int) -> DataFrame:
    """anchor, __sd_key, again: distinct anchors of each text; again: it may repeat there.

    Copies of a text in one batch of rows give their anchors once.
    """
    def run(batches):
        for batch in batches:
            out, seen = [[], [], []], set()
            for key, text in zip(batch.column("__sd_key").to_pylist(),
                                 batch.column("__sd_text").to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                anchors, _, _, own, _ = contexts_of(text.encode(), width, k)
                if not len(anchors):
                    continue
                found, at, n = np.unique(anchors, return_inverse=True, return_counts=True)
                inside = np.zeros(len(found), bool)
                np.logical_or.at(inside, at, own)
                out[0].append(found.view(np.int64))
                out[1].append(np.full(len(found), key))
                out[2].append((n > 1) | inside)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in out], ["anchor", "__sd_key", "again"])

    return keyed.select("__sd_key", "__sd_text").mapInArrow(
        run, "anchor long, __sd_key long, again boolean")


def _context_rows(docs: DataFrame, width: int, k: int) -> DataFrame:
    """route, __sd_id, __sd_key, start, at, context of rows that carry their anchors to keep.

    at: the place of the anchor in the context, null where it is met at several places.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for row_id, key, text, kept in zip(*[batch.column(c).to_pylist() for c in (
                    "__sd_id", "__sd_key", "__sd_text", "kept")]):
                data = text.encode()
                hot = {a["anchor"]: a["hot"] for a in kept}
                anchors, first, size, own, at = contexts_of(data, width, k)
                for a, f, s, o, p in zip(anchors.view(np.int64).tolist(), first.tolist(),
                                         size.tolist(), own.tolist(), at.tolist()):
                    if a not in hot:
                        continue
                    if hot[a]:
                        for w in range(f, f + s):
                            part = data[w: w + width]
                            route = xxhash.xxh3_64_intdigest(part) - 2**63
                            rows.append((route, row_id, key, w, 0, part))
                    else:
                        rows.append((a, row_id, key, f, None if o else p, data[f: f + s + width - 1]))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = (*[pa.int64()] * 4, pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
            ["route", "__sd_id", "__sd_key", "start", "at", "context"])

    return docs.mapInArrow(run, "route long, __sd_id long, __sd_key long, start long, "
                                "at int, context binary")


def sharing(group: list[tuple[int | None, bytes]], width: int, k: int) -> list[bool]:
    """Which of the distinct contexts (at, bytes) of an anchor may share a window with another.

    Equal windows have the anchor at the same place, so the bytes of at least half of the rest
    before it, or of half after it, are equal in both.  Where a context meets its anchor at several
    places, every one may.
    """
    if any(at is None for at, _ in group):
        return [True] * len(group)
    half = (width - k) // 2
    held: dict[bytes, int] = {}
    out = [False] * len(group)
    for side in (0, 1):
        held.clear()
        for i, (at, context) in enumerate(group):
            low, high = (at, at + k + half) if side else (at - half, at + k)
            if low >= 0 and high <= len(context):
                other = held.setdefault(context[low:high], i)
                if other != i:
                    out[i] = out[other] = True
    return out


def _marks(contexts: DataFrame, width: int, k: int, batch_bytes: int) -> DataFrame:
    """__sd_id, __sd_key, start, n: runs of n windows that also start earlier."""
    def run(batches):
        marks, held = [], []  # held: first occurrences of the batch's distinct contexts
        size, route, seen, group = 0, None, {}, []

        def close():
            """Put the distinct contexts of an anchor that may share windows into the batch.

            A single one has no windows in common with others, and unless its anchor is met in
            it more than once none with itself.
            """
            nonlocal size
            if len(group) > 1 or (group and group[0][4] is None):
                shared = sharing([(g[4], g[3]) for g in group], width, k)
                kept = [g for g, s in zip(group, shared) if s]
                held.extend(kept)
                size += sum(len(g[3]) for g in kept)
            group.clear()

        def flush():
            found = repeated_windows([h[3] for h in held], width)
            for (row_id, key, start, *_), flags in zip(held, found):
                marks.extend((row_id, key, start + f, n) for f, n in runs_of(flags))

        def out():
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*marks)] if marks else
                [pa.array([], pa.int64())] * 4, ["__sd_id", "__sd_key", "start", "n"])
            marks.clear()
            return made

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (
                "route", "__sd_id", "__sd_key", "start", "context", "at")]
            for r, row_id, key, start, context, at in zip(*columns):
                if r != route:
                    close()
                    route, seen = r, {}
                    if size >= batch_bytes:
                        flush()
                        held.clear()
                        size = 0
                first = seen.get(context)
                if first is None:
                    seen[context] = (row_id, start)
                    group.append((row_id, key, start, context, at))
                elif (row_id, start) > first:
                    marks.append((row_id, key, start, len(context) - width + 1))
            if len(marks) > 50_000:
                yield out()
        close()
        if held:
            flush()
        yield out()

    dealt = contexts.repartition("route").sortWithinPartitions("route", "__sd_id", "start")
    return dealt.mapInArrow(run, "__sd_id long, __sd_key long, start long, n long")


def spans_of(marks, width: int) -> list[tuple[int, int]]:
    """Disjoint byte spans (from, to) of marked windows (start, n), in order; adjacent ones joined."""
    out: list[list[int]] = []
    for start, n in sorted(marks):
        end = start + n + width - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def repeats(docs: DataFrame, width: int = WIDTH, k: int = K, hot: int = HOT,
            batch_bytes: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Texts by (__sd_id, __sd_key), and what is repeated in them: copy, marks.

    Both come from the same exchange of the texts, so that a join of them shuffles no text.
    """
    keyed = _keyed(docs)
    names = written(keyed.select("__sd_id", "__sd_key",
                                 F.octet_length("__sd_text").alias("size")), "repeats-texts")
    first = names.groupBy("__sd_key").agg(F.min("__sd_id").alias("first"))
    anchors = written(_anchor_rows(keyed, width, k), "repeats-all-anchors")
    common = anchors.groupBy("anchor").agg(
        (F.min("__sd_key") < F.max("__sd_key")).alias("common"), F.max("again").alias("again"),
        (F.count(F.lit(1)) > hot).alias("hot"),
    ).filter("common OR again").select("anchor", "hot")
    kept = anchors.select("anchor", "__sd_key").join(common, "anchor").join(first, "__sd_key")
    kept = kept.groupBy(F.col("first").alias("__sd_id"), "__sd_key").agg(
        F.collect_set(F.struct("anchor", "hot")).alias("kept"))  # at most a text's length
    kept = written(kept, "repeats-anchors")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.repartition(parts, "__sd_id", "__sd_key")
    marks = _marks(_context_rows(texts.join(kept, ["__sd_id", "__sd_key"]), width, k),
                   width, k, batch_bytes)
    marks = marks.groupBy("__sd_id", "__sd_key").agg(
        F.collect_set(F.struct("start", "n")).alias("marks"))
    info = names.join(first, "__sd_key").select(
        "__sd_id", "__sd_key",
        ((F.col("first") < F.col("__sd_id")) & (F.col("size") >= width)).alias("copy"),
    ).distinct()
    return texts, info.join(marks, ["__sd_id", "__sd_key"], "left")


def _spans(size: int, copy: bool, marks, width: int):
    if copy:
        return [(0, size)]
    return spans_of([(m["start"], m["n"]) for m in (() if marks is None else marks)], width)


def digest_repeats(docs: DataFrame, width: int = WIDTH, k: int = K, hot: int = HOT,
                   batch_bytes: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs`."""
    texts, info = repeats(docs, width, k, hot, batch_bytes)

    def run(batches):
        for batch in batches:
            out = []
            for row_id, text, copy, marks in zip(*[batch.column(c).to_pylist() for c in (
                    "__sd_id", "__sd_text", "copy", "marks")]):
                data = text.encode()
                spans = _spans(len(data), copy, marks, width)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((None if row_id == 2**63 - 1 else row_id, len(data),
                            sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.join(info, ["__sd_id", "__sd_key"], "left").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(text: str, copy: bool, marks, width: int) -> str:
    """The text without its repeated spans, each narrowed to whole characters."""
    data = text.encode()
    out, at = [], 0
    for a, b in _spans(len(data), copy, marks, width):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Rows of `docs` with text cut (n_chars set to its length), without those left blank."""
    _, info = repeats(docs, width, k)
    info = written(info, "repeats-marks")

    @F.pandas_udf("string")
    def cut(text, copy, marks):
        import pandas as pd

        return pd.Series([cut_text(t, bool(c), m, width) for t, c, m in zip(text, copy, marks)])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct(*docs.columns).alias("__sd_row"), text.alias("__sd_text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__sd_id"),
        F.xxhash64(text).alias("__sd_key"))
    joined = rows.join(info, ["__sd_id", "__sd_key"], "left").withColumn(
        "__sd_cut", F.when(F.col("copy") | F.col("marks").isNotNull(),
                           cut("__sd_text", "copy", "marks")).otherwise(F.col("__sd_text")))
    new = {"text": F.col("__sd_cut"), "n_chars": F.length("__sd_cut").cast("long")}
    return joined.filter(F.trim("__sd_cut", F.lit(" \t\n\x0b\x0c\r")) != "").select(*[
        new[c].alias(c) if c in new else F.col("__sd_row")[c].alias(c) for c in docs.columns])
