"""Language-model scores from a hashed maximum-entropy model.

The probability of a token is factored: its class, its member of the class, and the token within
the member.

- Half of the classes hold the most frequent training tokens, one to a member.  The others hold all
  remaining tokens, known or not: the class follows the word's ending (its last four bytes, hashed;
  endings are clustered by the short words that they come after in the training corpus), the
  member its beginning.
  Classes and members are each near the fourth root of the counted vocabulary, so that members
  number, and on average hold, near its square root of words.
- The class follows a maximum-entropy (softmax) model over features of the words before: the
  member of the last word, of the word before it (a skip), the last two words together (hashed), and
  the last frequent word before those (a long skip).
- The member follows a softmax over hashed pairs of the class with the last word's member, and
  with the last frequent word.
- The token within its member follows smoothed counts over the whole training corpus.

Each feature is a row of weights in one table whose size follows the vocabulary.  Each member of
infrequent tokens keeps half a count for unknown ones, so that probabilities of known tokens and
one unknown event per such member sum to one.

Training is by distributed gradient updates: in each round every partition of that round's
documents runs mini-batch gradient steps from the current weights, and the weights are averaged,
each row weighted by how often a partition used it.  Every training document is used in one round, and
every token of it trains all of its features.

Scoring reads texts where they are.  The most frequent words' counts (VOCABULARY words at most) go
to every task as numbers; every other word of a document is joined with the corpus counts by
Spark, and its part of the score is added.  Texts are never shuffled; counts grow with the corpus
and never leave Spark's tables.

Defined results: a null text is empty and has one token, its end.  A null doc_id counts as
training and is scored.  Repeated rows count and are scored each.  Without training rows the
vocabulary is empty.  An empty table gives no rows.  Other columns are left out.
"""

import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pennywright.llm.shared import written

ROUNDS = 2
STEP = 8192  # tokens of a gradient step
RATE = 0.5  # shared by the features of a token
LARGEST = 10.0  # of a weight
CELL = 256  # rows of weights that are averaged together
CHUNK = 1_500_000  # characters of the texts that are handled at once
VOCABULARY = 1_000_000  # counts that every task has at hand, 16 bytes each
KEPT_COUNTS = 300_000  # words that a counting task keeps before it sends them on
END = b""  # no word is empty, so this stands for the end of a text
ENDINGS = 16384  # hashed endings that are clustered
ANCHORS = 64  # hashed short words that endings are clustered by
SHORT = 3  # bytes of a short word
CLASS_FEATURES, MEMBER_FEATURES = 4, 2


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; the end is added by the caller."""
    return (text or "").encode().lower().split()


word_hash = xxhash.xxh64_intdigest


def width_of(distinct: int) -> int:
    """Classes, and members of a class: 0.8 times the fourth root of the vocabulary, a multiple of 4."""
    return max(8, 4 * round(0.2 * distinct ** 0.25))


@dataclass
class Model:
    width: int  # classes, and members of a class
    own: dict  # frequent token -> class * width + member
    of_ending: np.ndarray  # (ENDINGS): class of infrequent words by the hash of their ending
    mass: np.ndarray  # (width * width): counts plus smoothing of each member
    weights: np.ndarray  # (rows, width), float32
    total: int = 0
    distinct: int = 0

    def __post_init__(self):
        self.set_bias()

    def set_bias(self) -> None:
        mass = self.mass.reshape(self.width, self.width)
        self.class_bias = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        self.member_bias = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)

    def place_of(self, word: bytes) -> int:
        """class * width + member"""
        found = self.own.get(word)
        return found if found is not None else self.infrequent_place(word)

    def infrequent_place(self, word: bytes) -> int:
        return int(self.of_ending[ending(word)]) * self.width + zlib.crc32(word[:3]) % self.width


def ending(word: bytes) -> int:
    return zlib.crc32(word[-4:]) % ENDINGS


def clustered(profiles: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Cluster (0 to k - 1) of each row of counts: k-means of the rows' square-rooted shares.

    Rows weigh as much as they count.  The first centres are the heaviest row and then, in turn,
    the row of most weight times distance from the centres so far.
    """
    weight = profiles.sum(1)
    share = profiles.sum(0) / max(1, weight.sum())
    points = np.sqrt((profiles + 20 * share) / (weight[:, None] + 20))
    centres = points[[int(weight.argmax())]]
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres = np.vstack([centres, points[int((weight * far).argmax())]])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        at = (points @ centres.T - 0.5 * (centres ** 2).sum(1)).argmax(1)
        for c in range(k):
            rows = (at == c) & (weight > 0)
            if rows.any():
                centres[c] = np.average(points[rows], axis=0, weights=weight[rows])
    return at


def table_rows(width: int) -> int:
    """Rows of weights: three tables by member, one of word pairs, two by class and member."""
    rows = 3 * (width * width + 1) + 12 * width * width
    return -(-rows // CELL) * CELL


def features_of(width: int, hashes, places, starts):
    """Rows of weights for each token: (tokens, CLASS_FEATURES) and (tokens, MEMBER_FEATURES).

    hashes, places: of the tokens, all texts one after the other; starts: whether a text
    begins there.
    """
    n, square = len(hashes), width * width
    index = np.arange(n)
    begin = np.maximum.accumulate(np.where(starts, index, 0))

    def back(values, by, none):
        out = np.full(n, none, values.dtype)
        out[by:] = values[: max(0, n - by)]
        out[index - begin < by] = none
        return out

    one, two = back(places, 1, square), back(places, 2, square)
    frequent = np.maximum.accumulate(np.where(places < (width - width // 2) * width, index, -1))
    at = back(frequent, 3, -1)
    skip = np.where(at >= begin, places[at], square)
    pair = back(hashes, 1, 7) * np.uint64(0x9E3779B97F4A7C15) + back(hashes, 2, 7)
    base = 3 * (square + 1)
    by_class = np.empty((n, CLASS_FEATURES), np.int64)
    by_class[:, 0], by_class[:, 1], by_class[:, 2] = one, two + (square + 1), skip + 2 * (square + 1)
    by_class[:, 3] = _spread(pair, 4 * square) + base
    own = (places // width).astype(np.uint64) << np.uint64(32)
    by_member = np.empty((n, MEMBER_FEATURES), np.int64)
    by_member[:, 0] = _spread(own + one.astype(np.uint64), 4 * square) + base + 4 * square
    by_member[:, 1] = _spread(own + skip.astype(np.uint64), 4 * square) + base + 8 * square
    return by_class, by_member


def _spread(keys: np.ndarray, rows: int) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((keys >> np.uint64(24)) % np.uint64(rows)).astype(np.int64)


def softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray):
    """Unscaled probabilities for every row of features, (tokens, width), and their sums.

    Weights are kept within LARGEST, so that nothing overflows.
    """
    out = weights.take(rows[:, 0], axis=0)
    for f in range(1, rows.shape[1]):
        out += weights.take(rows[:, f], axis=0)
    out += bias
    np.exp(out, out=out)
    return out, out @ np.ones(out.shape[1], np.float32)


class Trainer:
    """Mini-batch gradient steps with a rate for each row, from given weights."""

    def __init__(self, model: Model, seen: float):
        self.model = model
        self.weights = model.weights.copy()
        self.seen = np.full(len(self.weights), seen, np.float32)  # mean squares of gradients
        self.used = np.zeros(len(self.weights), np.int64)  # tokens that used a row

    def step(self, rows: np.ndarray, targets: np.ndarray, bias: np.ndarray) -> None:
        """A gradient step over all tokens, for the weights of all their features."""
        gradient, sums = softmax(self.weights, rows, bias)
        gradient /= sums[:, None]
        gradient[np.arange(len(rows)), targets] -= 1
        for f in range(rows.shape[1]):
            keys = rows[:, f]
            near = keys - keys.min()
            # small numbers are sorted much faster
            order = np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            total = np.add.reduceat(gradient.take(order, axis=0), first, axis=0)
            at = keys[first]
            self.used[at] += np.diff(np.r_[first, len(keys)])
            seen = self.seen[at] + np.einsum("ij,ij->i", total, total) / total.shape[1]
            self.seen[at] = seen
            total *= (RATE / rows.shape[1] / np.sqrt(seen))[:, None]
            self.weights[at] = np.clip(self.weights.take(at, axis=0) - total, -LARGEST, LARGEST)

    def texts(self, texts) -> None:
        """Train on whole texts; steps may span them."""
        model = self.model
        words, ids, starts, _ = flat([tokens_of(t) for t in texts])
        hashes, places = encoded(model, words)
        places = places[ids]
        by_class, by_member = features_of(model.width, hashes[ids], places, starts)
        classes, members = np.divmod(places, model.width)
        for i in range(0, len(ids), STEP):
            part = slice(i, i + STEP)
            self.step(by_class[part], classes[part], model.class_bias)
            self.step(by_member[part], members[part], model.member_bias[classes[part]])


def flat(split: list[list[bytes]]):
    """Distinct tokens, and each token's index among them, texts ended and joined."""
    every: list[bytes] = []
    for words in split:
        every += words
        every.append(END)
    index = defaultdict(count().__next__)  # numbers tokens as they are first looked up
    ids = np.fromiter(map(index.__getitem__, every), np.int64, len(every))
    sizes = np.array([len(words) + 1 for words in split])
    starts = np.zeros(len(ids), bool)
    starts[np.cumsum(sizes) - sizes] = True
    return list(index), ids, starts, sizes


def encoded(model: Model, words: list[bytes]):
    """Hash and place of each word."""
    crc, get, width = zlib.crc32, model.own.get, model.width
    classes = [int(c) * width for c in model.of_ending]
    places = [p if (p := get(w)) is not None else classes[crc(w[-4:]) % ENDINGS] + crc(w[:3]) % width
              for w in words]
    return np.array(list(map(word_hash, words)), np.uint64), np.array(places, np.int64)


def chunks(batch: pa.RecordBatch):
    """The batch in runs of rows of about CHUNK characters; a longer text is a run of its own."""
    start, held = 0, 0
    texts = batch.column("text").to_pylist()
    for i, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > CHUNK:
            yield batch.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += size
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def held_out(remainder: int, modulus: int) -> Column:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return F.coalesce(part == remainder, F.lit(False))


def count_all(train: DataFrame) -> DataFrame:
    """word, at and n over all rows of `train`: the counts of words (binary; empty for the end), and those
    of the cells of ending_profiles, each without the other's name."""
    def run(batches):
        held: dict[bytes, int] = {}
        cells = np.zeros(ENDINGS * ANCHORS, np.int64)

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.nulls(len(held), pa.int32()),
                 pa.array(list(held.values()), pa.int64())], ["word", "at", "n"])

        for batch in batches:
            for _, texts in chunks(batch):
                words, ids, starts, _ = flat([tokens_of(t) for t in texts])
                cells += profile(words, ids, starts)
                for w, n in zip(words, np.bincount(ids, minlength=len(words)).tolist()):
                    held[w] = held.get(w, 0) + n
                if len(held) > KEPT_COUNTS:
                    yield out()
                    held = {}
        yield out()
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(cells[at])],
            ["word", "at", "n"])

    return train.select("text").mapInArrow(run, "word binary, at int, n long").groupBy("word", "at").agg(
        F.sum("n").alias("n"))


def token_counts(sums: DataFrame) -> DataFrame:
    return sums.filter("word IS NOT NULL").select("word", "n")


def profile(words, ids, starts) -> np.ndarray:
    """How often each hashed ending comes after each hashed short word, no other one between, as one row."""
    short = np.fromiter((zlib.crc32(w) % ANCHORS if 0 < len(w) <= SHORT else -1 for w in words),
                        np.int64, len(words))[ids]
    at = np.array([zlib.crc32(w[-4:]) % ENDINGS for w in words], np.int64)[ids]
    index = np.arange(len(ids))
    begin = np.maximum.accumulate(np.where(starts, index, 0))
    last = np.maximum.accumulate(np.where(short >= 0, index, -1))
    use = (short < 0) & (last >= begin)
    return np.bincount(at[use] * ANCHORS + short[last[use]], minlength=ENDINGS * ANCHORS)


def ending_profiles(sums: DataFrame) -> np.ndarray:
    """The profiles of all training texts, (ENDINGS, ANCHORS)."""
    out = np.zeros(ENDINGS * ANCHORS, np.int64)
    found = sums.filter("at IS NOT NULL").select("at", "n").toArrow()  # at most that many rows
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(ENDINGS, -1)


def member_masses(counts: DataFrame, model: Model) -> np.ndarray:
    """Tokens and half the distinct tokens of each member; half a count more where words may come."""
    width = model.width

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            at = np.fromiter(map(model.place_of, words), np.int64, len(words))
            n = np.bincount(at, batch.column("n").to_numpy(), width * width).astype(np.int64)
            v = np.bincount(at, minlength=width * width)
            place = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(n[place]), pa.array(v[place])], ["place", "n", "v"])

    mass = np.full(width * width, 1e-12)  # a frequent member without a word never occurs
    mass[(width - width // 2) * width:] = 0.5
    found = counts.mapInArrow(run, "place long, n long, v long").groupBy("place").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v"))
    for r in found.collect():  # width * width rows
        mass[r.place] += r.n + 0.5 * r.v
    return mass


def averaged(train: DataFrame, model: Model, seen: float) -> np.ndarray:
    """Weights after every partition trained on its rows, each row averaged by its use."""
    def run(batches):
        trainer = Trainer(model, seen)
        for batch in batches:
            for _, texts in chunks(batch):
                trainer.texts(texts)
        change = (trainer.weights - model.weights).astype("<f2").reshape(-1, CELL, model.width)
        used = trainer.used.astype("<i8").reshape(-1, CELL)
        cells = np.flatnonzero(used.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), pa.array([used[c].tobytes() for c in cells], pa.binary()),
             pa.array([change[c].tobytes() for c in cells], pa.binary())], ["cell", "used", "part"])

    def add(key, pdf):
        total, uses = 0, 0
        for used, part in zip(pdf["used"], pdf["part"]):
            used = np.frombuffer(used, "<i8")
            total = total + used[:, None] * np.frombuffer(part, "<f2").reshape(CELL, -1).astype(float)
            uses = uses + used
        mean = total / np.maximum(uses, 1)[:, None]
        return pd.DataFrame({"cell": [key[0]], "used": [uses.tobytes()],
                             "part": [mean.astype("<f2").tobytes()]})

    kind = "cell int, used binary, part binary"
    parts = train.select("text").mapInArrow(run, kind)
    # two steps, so that no task gathers the changes of very many partitions
    parts = parts.withColumn("some", F.pmod(F.xxhash64("part"), F.lit(64)))
    mean = parts.groupBy("cell", "some").applyInPandas(add, kind)
    mean = mean.groupBy("cell").applyInPandas(add, kind)
    out = model.weights.copy()
    for r in mean.select("cell", "part").collect():  # the size of the model
        at = r.cell * CELL
        out[at: at + CELL] += np.frombuffer(r.part, "<f2").reshape(CELL, -1)
    return out


def fit(train: DataFrame, sums: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model of rows with doc_id and text; `sums` are those of count_all."""
    counts = token_counts(sums)
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    width = width_of(totals.v)
    frequent = counts.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(
        (width - width // 2) * width - 1)  # about half the square root of the vocabulary
    own = {END: 0} | {bytes(r.word): i + 1 for i, r in enumerate(frequent.collect())}
    classes = width - width // 2 + clustered(ending_profiles(sums), width // 2)
    model = Model(width, own, classes, np.ones(width * width),
                  np.zeros((table_rows(width), width), np.float32), totals.n or 0, totals.v)
    model.mass = member_masses(counts, model)
    model.set_bias()
    if model.total:
        share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
        for r in range(rounds):
            model.weights = averaged(train.filter(share == r), model, 1.0 if r else 1e-2)
    return model


def frequent_counts(counts: DataFrame, most: int = VOCABULARY):
    """Sorted hashes and counts of the words of at least some count, and that count.

    The count is the least that at most `most` words reach.
    """
    level = F.floor(F.log2("n") * 8)
    levels = counts.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect()  # at most 512 rows
    least, words = 1 << 62, 0
    for r in sorted(levels, key=lambda r: -r.level):
        words += r.words
        if words > most:
            break
        least = r.n
    found = counts.filter(F.col("n") >= least).select("word", "n").toArrow()
    hashes = np.fromiter(map(word_hash, found.column("word").to_pylist()), np.uint64, found.num_rows)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order].astype(np.int64), least


def text_logs(model: Model, ids, starts, hashes, places) -> np.ndarray:
    """Natural log of each token's class and member, less that of the member's mass."""
    all_places = places[ids]
    by_class, by_member = features_of(model.width, hashes[ids], all_places, starts)
    classes, members = np.divmod(all_places, model.width)
    log = -np.log(model.mass)[all_places]
    for i in range(0, len(ids), STEP):
        part = slice(i, i + STEP)
        each = np.arange(len(classes[part]))
        for rows, targets, bias in (
                (by_class, classes, model.class_bias),
                (by_member, members, model.member_bias[classes[part]])):
            found, sums = softmax(model.weights, rows[part], bias)
            log[part] += np.log(found[each, targets[part]]) - np.log(sums)
    return log


def score_documents(docs: DataFrame, remainder: int = 1, modulus: int = 5,
                    vocabulary: int = VOCABULARY) -> DataFrame:
    """Scores of every row of `docs`, learnt from rows whose fold is not `remainder`."""
    rows = docs.select("doc_id", "text", held_out(remainder, modulus).alias("held_out"))
    train = rows.filter("NOT held_out")
    sums = written(count_all(train), "model-counts")
    counts = token_counts(sums)
    model = fit(train, sums)
    known, known_n, _ = frequent_counts(counts, vocabulary)

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch):
                words, ids, starts, sizes = flat([tokens_of(t) for t in texts])
                hashes, places = encoded(model, words)
                n = np.zeros(len(words), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    n = np.where(known[at] == hashes, known_n[at], 0)
                log = text_logs(model, ids, starts, hashes, places) / np.log(10)
                # the log of a rare word's count is added after the join
                count_log = np.where(n > 0, np.log10(n + 0.5), 0.0)[ids]
                first = np.cumsum(sizes) - sizes
                rare = np.flatnonzero((n == 0)[ids])
                text_of = np.searchsorted(first, rare, "right") - 1
                where, times = np.unique(text_of * len(words) + ids[rare], return_counts=True)
                owner, word = np.divmod(where, len(words))
                offsets = pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(sizes, pa.int64()),
                     pa.array(np.add.reduceat((n > 0)[ids].astype(np.int64), first)),
                     pa.array(np.add.reduceat(count_log, first)),
                     pa.array(np.add.reduceat(log, first)),
                     pa.ListArray.from_arrays(offsets, pa.array([words[i] for i in word], pa.binary())),
                     pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "count_log", "log", "rare", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    read = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                "count_log double, log double, rare array<binary>, times array<long>")
    # the number of a row is stored with it, so that it is the same for every later reader
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "model-rows")
    rare = read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rest = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("more_log"))
    count_log = F.col("count_log") + F.coalesce("more_log", F.lit(0.0))
    smooth = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return read.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (count_log - F.col("n_tokens") * F.lit(smooth)).alias("base_score"),
        (F.col("log") + count_log).alias("score"))
