"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents are tokenized and end with one end id.  Only those longer than a sequence are
cut, into full pieces and one shorter last piece.  Pieces are interchangeable by length, so
the packing is planned on the histogram of lengths, which has at most `capacity` entries
whatever the corpus:

1. lengths are grouped into classes; the configuration linear program (cover each class's
   count by patterns of total length at most `capacity`, with the fewest patterns) is solved
   by multiplicative weights; each round prices a pattern by dynamic programming over an
   unbounded knapsack;
2. the fractional use of each pattern is rounded down, and its slots take real pieces;
3. what is left is placed by best fit, longest first, into the room of those sequences and
   new ones, in groups of like sequences.

The plan is a list of slots (length, from rank, to rank, first sequence, ...).  Pieces get a
rank within their length and join the slots; nothing else passes the driver.

Scale: ranks are made per (length, slice), a slice being a hash of the piece, so that a length
which a third of all pieces share is numbered by many tasks.  The plan's size depends on the
number of lengths and rounds only.

Defined results: a null text is empty, so its document is the end id alone; repeated rows are
packed each; a null doc_id is carried along; an empty table gives no rows; other columns are
left out.  The tokenizer's special strings inside a text are ordinary text.
"""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pennywright.llm.shared import small, written

CAPACITY = 4096
END_ID = 1
SLICES = 4096
CLASSES = 64  # of lengths, in the linear program
ROUNDS = 250  # of multiplicative weights
STEP, RATE = 0.25, 4.0  # share of a demand that a round covers at most; fall of the weights
SCALES = (1.0, 0.9, 0.7, 0.4, 0.0)  # of the fractional uses before rounding down
CACHE_BYTES = 160_000_000  # about what the encoded words that a Python worker keeps may take
ENTRY_BYTES = 250  # of a kept word besides its letters and ids
CHUNK_CHARS = 4_000_000  # of the texts that are encoded at once
WORD_END = "</w>"  # the tokenizer's mark on tokens that end a word
#: Characters that str.split() parts at and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f\ud800-\udfff]")
_MARK = re.compile("[\u0300-\u036f]")
_END = re.compile(r"[.,;:!?|#*$%&](?<=[^\W\d_][.,;:!?|#*$%&])")  # the mark is sought first: cheaper


class WordEncoder:
    """Encodes texts with a tokenizer that never joins characters across white space.

    Words repeat, so each distinct one is encoded once and its ids are kept as bytes
    (little-endian unsigned 32-bit).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes of known words
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        for token, i in vocabulary.items():
            self.last[i] = token.endswith(WORD_END)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 10_000):
            found = self.tokenizer.encode_batch_fast(
                texts[i: i + 10_000], add_special_tokens=False)
            out += [np.asarray(e.ids, "<u4").tobytes() for e in found]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: many in one text, parted where a word ends.

        That is cheaper than a text per word.  Where normalizing would part a word, the
        number of ends shows it, and the words are encoded one by one.
        """
        out = []
        for i in range(0, len(words), 2_000):
            some = words[i: i + 2_000]
            ids = np.frombuffer(self._encode([" ".join(some)])[0], "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                data, at = ids.tobytes(), 0
                for end in (4 * ends).tolist():
                    out.append(data[at:end])
                    at = end
            else:
                out += self._encode(some)
        return out

    @staticmethod
    def _words(text: str) -> list[str] | None:
        """Parts whose ids, one after the other, are those of the text; None if not sure.

        A run of letters always ends a token, so that text may be parted before a punctuation
        mark that follows a letter.  A-Z may be lower-cased first (the tokenizer does so),
        unless a combining mark could join a letter.
        """
        if _ODD.search(text):
            return None
        if text.isascii() or not _MARK.search(text):
            text = text.encode().lower().decode()
        return _END.sub(r" \g<0>", text).split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new words of all of them are encoded together."""
        known = self.known
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        split = [self._words(t) for t in texts]
        fresh: set[str] = set()
        for words in split:
            if words:
                fresh.update(words)
        fresh = {w for w in fresh if w not in known}
        plain = [w for w in fresh if w.isalpha()]
        other = list(fresh.difference(plain))
        for words, data in ((plain, self._encode_words(plain)), (other, self._encode(other))):
            known.update(zip(words, data))
            self.held += sum(map(len, words)) + sum(map(len, data)) + ENTRY_BYTES * len(words)
        out = [b"".join(map(known.__getitem__, words)) if words else b"" for words in split]
        whole = [i for i, words in enumerate(split) if words is None]
        for i, data in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = data
        return out


def _chunks(batch: pa.RecordBatch):
    """The batch in runs of rows of about CHUNK_CHARS characters; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
           ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (packed 32-bit numbers)."""
    end = np.asarray([END_ID], "<u4").tobytes()
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        encode = WordEncoder(tokenizer_path)
        for batch in (chunk for whole in batches for chunk in _chunks(whole)):
            rows, columns = [], [[] for _ in range(5)]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, data in enumerate(encode(texts)):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at: at + 4 * capacity]
                    rows.append(i)
                    made = (piece, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(columns, made):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns[: 4 + ids], kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *arrays],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + (", ids binary" if ids else ""))


def best_pattern(values: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern of greatest value within `capacity`; values[l] is that of length l, 0 if none.

    best[c] is the greatest value within c; it never falls with c.
    """
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    worth = np.where(values > 0, values, -1.0)
    smallest = int(np.flatnonzero(values > 0)[0])
    for c in range(smallest, capacity + 1):
        total = best[:c][::-1] + worth[1: c + 1]  # by length 1 .. c
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], choice[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = {}
    c = capacity
    while c >= smallest:
        if choice[c]:
            pattern[int(choice[c])] = pattern.get(int(choice[c]), 0) + 1
            c -= int(choice[c])
        else:
            c -= 1
    return pattern


def classes_of(counts: np.ndarray, most: int = CLASSES) -> list[list[tuple[int, int]]]:
    """Lengths in runs (length, count), longest first, cut into classes of about equal total."""
    lengths = np.flatnonzero(counts)[::-1]
    total = int((lengths * counts[lengths]).sum())
    out, used = [], 0
    for x in lengths:
        if not out or (used * most >= total * len(out) and len(out) < most):
            out.append([])
        out[-1].append((int(x), int(counts[x])))
        used += int(x) * int(counts[x])
    return out


def fractional_cover(sizes, demands, capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Patterns of classes with their fractional use: the configuration linear program.

    A class counts with the size of its longest piece.  Its price is its weight over its
    demand; a weight falls exponentially with the share of the demand that is covered.  A round
    prices a pattern and uses it as far as covers STEP of the demand of its scarcest class.
    At the end all uses are scaled so that the least covered class is covered once.
    """
    at = {size: g for g, size in enumerate(sizes)}
    demands = np.asarray(demands, float)
    share = np.zeros(len(sizes))
    use: dict[tuple, float] = {}
    for _ in range(rounds):
        prices = np.zeros(capacity + 1)
        prices[sizes] = np.exp(-RATE * (share - share.min())) / demands
        pattern = [(at[x], n) for x, n in best_pattern(prices, capacity).items()]
        amount = STEP * min(demands[g] / n for g, n in pattern)
        key = tuple(sorted(pattern))
        use[key] = use.get(key, 0.0) + amount
        for g, n in pattern:
            share[g] += amount * n / demands[g]
    least = max(float(share.min()), STEP)
    return {k: v / least for k, v in use.items()}


def _alike(lists, times: int):
    """Cut `times` sequences, whose slots take runs from `lists`, into groups alike."""
    places = [[0, 0] for _ in lists]  # run, and how many of it are used
    while times:
        take = min([times, *(runs[p[0]][1] - p[1] for runs, p in zip(lists, places))])
        yield [runs[p[0]][0] for runs, p in zip(lists, places)], take
        times -= take
        for runs, p in zip(lists, places):
            p[1] += take
            if p[1] == runs[p[0]][1]:
                p[0], p[1] = p[0] + 1, 0


def round_down(use: dict, groups, scale: float):
    """Open sequences for the rounded-down uses, and the counts of lengths left.

    Slots of a class take its pieces longest first.  Returns [(contents, how many)] and runs.
    """
    runs = [list(g) for g in groups]
    left = [sum(n for _, n in g) for g in groups]
    opened = []

    def draw(g, n):
        out = []
        while n:
            x, have = runs[g][0]
            k = min(have, n)
            out.append((x, k))
            runs[g][0] = (x, have - k)
            if have == k:
                runs[g].pop(0)
            n -= k
        return out

    for key, amount in sorted(use.items(), key=lambda p: (-p[1], p[0])):
        times = min(int(amount * scale), *(left[g] // n for g, n in key))
        if times <= 0:
            continue
        lists = []
        for g, n in key:
            left[g] -= n * times
            lists += [draw(g, times) for _ in range(n)]
        opened += [(tuple((x, 1) for x in xs), k) for xs, k in _alike(lists, times)]
    return opened, [r for g in runs for r in g]


def best_fit(opened, runs, capacity: int):
    """Place runs (length, count), longest first, each into the fullest sequence that it fits.

    Sequences with like contents are one group, so the work follows the number of groups.
    """
    groups: dict[int, list] = {}  # room -> [(contents, how many)]
    rooms = np.zeros(capacity + 1, bool)

    def put(contents, room, times):
        groups.setdefault(room, []).append((contents, times))
        rooms[room] = True

    for contents, times in opened:
        put(contents, capacity - sum(x * n for x, n in contents), times)
    for x, todo in sorted(runs, reverse=True):
        while todo:
            fits = np.flatnonzero(rooms[x:])
            if not fits.size:
                per = capacity // x
                if todo >= per:
                    put(((x, per),), capacity - per * x, todo // per)
                if todo % per:
                    put(((x, todo % per),), capacity - (todo % per) * x, 1)
                break
            room = x + int(fits[0])
            contents, times = groups[room].pop()
            if not groups[room]:
                rooms[room] = False
            used = min(times, todo)
            if times > used:
                put(contents, room, times - used)
            if contents[-1][0] == x:
                new = (*contents[:-1], (x, contents[-1][1] + 1))
            else:
                new = (*contents, (x, 1))
            put(new, room - x, used)
            todo -= used
    return [g for found in groups.values() for g in found]


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS):
    """(length, from_rank, to_rank, first_sequence, per_sequence, first_offset) rows.

    Ranks within a length count from 0.  The program's uses are rounded at a few scales and
    the plan with the fewest sequences is kept; scale 0 leaves all to best fit.
    """
    hist = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        hist[x] = n
    if not hist.any():
        return []
    groups = classes_of(hist)
    use = fractional_cover([g[0][0] for g in groups], [sum(n for _, n in g) for g in groups],
                           capacity, rounds)
    plans = [best_fit(*round_down(use, groups, scale), capacity) for scale in SCALES]
    chosen = min(plans, key=lambda plan: sum(n for _, n in plan))
    rows, rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for contents, times in chosen:
        offset = 0
        for x, n in contents:
            rows.append((x, int(rank[x]), int(rank[x] + n * times), sequence, n, offset))
            rank[x] += n * times
            offset += x * n
        sequence += times
    return rows


def ranked(parts: DataFrame) -> DataFrame:
    """Add _rank, the place of a piece within its length, from 0."""
    cut = parts.withColumn(
        "_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int"))
    sizes = cut.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_slice",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    return cut.withColumn("_rn", F.row_number().over(inside)).join(
        offsets, ["length", "_slice"]
    ).withColumn("_rank", F.col("_before") + F.col("_rn") - 1).drop("_slice", "_rn", "_before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
         ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset; with `ids`, the piece's ids too."""
    parts = written(pieces(docs, tokenizer_path, capacity, ids), "packing-pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = docs.sparkSession.createDataFrame(
        plan_slots(counts, capacity),
        "_length long, _from long, _to long, _first long, _per long, _offset long")
    slots = small(slots)  # else a length that very many pieces have would be one task
    placed = ranked(parts).join(slots, F.expr(
        "length = _length AND _rank >= _from AND _rank < _to"))
    place = F.col("_rank") - F.col("_from")
    return placed.select(
        *parts.columns,
        (F.col("_first") + F.expr("(_rank - _from) div _per")).alias("sequence_id"),
        (F.col("_offset") + F.pmod(place, F.col("_per")) * F.col("length")).alias("offset"),
    )
