"""Quality scores from random Fourier features of document statistics.

Statistics of the whole text (lengths, shares of kinds of characters, repetition) are
standardized and mapped to random Fourier features, cos(w.x + b) with normal w, whose
inner products approximate a Gaussian kernel.  Ridge regression on them is kernel
ridge regression: each partition sums its products of features, Spark adds the sums cell by
cell, and the normal equations are solved once.  The fitted values become probabilities by
isotonic regression on labelled rows that the ridge did not see.

The driver gets means, FEATURES * (FEATURES + 3) / 2 sums and at most BINS calibration
bins, whatever the input.  All labelled rows train; rows to score pass once.

Defined results: a null text is empty; an empty text has statistics of zeros and a score like any
other.  A null doc_id has no label.  Repeated rows are scored each; repeated labels of a
document are averaged; null labels are left out.  Without any label every score is 0.5.  An
empty table gives no rows.  Other columns are left out.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pennywright.llm.shared import written

FEATURES = 192
RIDGE = 1e-3  # per training row
BINS = 2000
SEED = 20
SYMBOL_BYTES = list(b"#*$%&|<>")
STATISTICS = (
    "log_chars", "log_words", "mean_word", "distinct_words", "distinct_pairs", "upper_words",
    "symbols", "bars", "stops", "commas", "marks", "digits", "upper_letters", "spaces",
    "log_line", "repeated_lines", "first_word", "other_script",
)


def statistics(text: str) -> list[float]:
    """The statistics of one text, each of a size around 0 to 10."""
    data = text.encode()
    if not data:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, size = max(len(words), 1), len(data)
    pairs = max(len(words) - 1, 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = set(words)
    first = words.count(words[0]) if words else 0
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n,
        len(distinct) / n, len(set(zip(words, words[1:]))) / pairs,
        sum(map(bytes.isupper, words)) / n,
        seen[SYMBOL_BYTES].sum() / n, seen[124] / n, seen[46] / n, seen[44] / n,
        (seen[33] + seen[63]) / n, seen[48:58].sum() / size, seen[65:91].sum() / size,
        seen[[32, 9, 10, 11, 12, 13]].sum() / size,
        np.log1p(size / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), first / n, seen[128:].sum() / size,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of doubles) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            values = [statistics(t or "") for t in batch.column("text").to_pylist()]
            stats = pa.array(values, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    """Standardization, random features, ridge weights and calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # calibration points, rising
    probability: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(stats), self.raw, self.probability)


def _array(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to `values` in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(train: DataFrame, calibrate: DataFrame, features: int = FEATURES,
        seed: int = SEED) -> Model:
    """A model from rows (stats, label); `calibrate` holds labelled rows kept from `train`."""
    dims = len(STATISTICS)
    moments = train.select(*[
        x for i in range(dims) for x in (
            F.avg(F.col("stats")[i]).alias(f"m{i}"), F.stddev_pop(F.col("stats")[i]).alias(f"s{i}"))
    ], F.count(F.lit(1)).alias("n")).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(dims)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(dims)])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    size = features + 1
    model = Model(mean, scale, rng.normal(size=(dims, features)) / np.sqrt(dims),
                  rng.uniform(0, 2 * np.pi, features), np.zeros(size),
                  np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not moments["n"]:
        return model
    upper = np.triu_indices(size)

    def products(batches):
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(_array(batch, "stats"))
            left += z.T @ z
            right += z.T @ batch.column("label").to_numpy(zero_copy_only=False)
        cells = np.concatenate([left[upper], right])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], ["cell", "part"])

    sums = train.mapInArrow(products, "cell int, part double").groupBy("cell").agg(
        F.sum("part").alias("total")).collect()  # size * (size + 3) / 2 rows
    cells = np.zeros(len(upper[0]) + size)
    for r in sums:
        cells[r.cell] = r.total
    left = np.zeros((size, size))
    left[upper] = cells[: len(upper[0])]
    left = left + np.triu(left, 1).T + RIDGE * moments["n"] * np.eye(size)
    model.weights = np.linalg.solve(left, cells[len(upper[0]):])

    def bins(batches):
        for batch in batches:
            raw = model.raw_scores(_array(batch, "stats"))
            at = np.clip(np.rint((raw + 0.5) / 2 * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], ["bin", "label"])

    found = calibrate.mapInArrow(bins, "bin int, label double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")
    ).orderBy("bin").collect()  # at most BINS + 1 rows
    if found:
        n = np.array([r.n for r in found], float)
        model.raw = np.array([r.bin for r in found]) / BINS * 2 - 0.5
        model.probability = isotonic(np.array([r.good for r in found]) / n, n)
    else:
        model.raw, model.probability = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def fold(modulus: int) -> Column:
    """CRC-32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 2, modulus: int = 4,
                    calibration: int = 3, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    Labels of fold `held_out` are never read; fold `calibration` fits the isotonic steps and
    the other folds the ridge.
    """
    stats = written(with_statistics(docs), "quality-statistics")
    part = fold(modulus)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(
        part != held_out).groupBy("doc_id").agg(F.avg("quality").cast("double").alias("label"))
    # one row per document: its statistics are the same in repeated rows of one text
    rows = stats.join(known, "doc_id").withColumn("fold", part)
    rows = written(rows, "quality-training")
    model = fit(rows.filter(F.col("fold") != calibration), rows.filter(F.col("fold") == calibration))
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches):
        for batch in batches:
            found = model.scores(_array(batch, "stats"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.clip(found, 0, 1))], ["doc_id", "score"])

    scored = stats.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", F.coalesce(part == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
