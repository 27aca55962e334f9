"""Vector code compression: every vector becomes one byte per part, its nearest codebook entry.

Codebooks start from the first vectors and move for some rounds, as in Lloyd's method.  Most
distances of the later rounds are never computed.  For each part of a vector and each group of
entries the task keeps a lower bound of the distance to the group and the round it was made in (its
stamp).  The codebooks of all rounds are kept, so a bound from round t is lowered by the distance
between where an entry stood at t and where it stands now: the norm of the sum of its moves, which
is never more than the sum of their norms.  Only groups whose lowered bound does not exceed the
exact distance to the vector's own entry are scanned again.

All arithmetic that decides is on whole numbers: floats are used only while they hold
the products exactly, else Python's integers.  Bounds are rounded down.

Defined results:
* vectors that are null or hold null or non-finite components are left out; so are vectors whose
  length differs from that of the smallest vec_id kept, and all of them if `parts` does
  not divide that length (there is nothing to cut them into);
* rows of one vec_id are all coded; the first codebook takes the rows of smallest (vec_id, vector),
  without null ids, and has fewer entries where there are fewer rows;
* an error beyond 64 bits is null, and so is a label's sum beyond 64 bits or with such an error;
* an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pennywright.llm.shared import small, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
GROUP = 8  # entries that share a bound
EXACT = 2.0 ** 52  # sums of products below this are exact in floats
LIMB = 32  # bits of a limb of the sums that tasks send
MOST_BOUND = 2 ** 16 - 1  # bounds are kept in 16 bits; a smaller bound is a valid one


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite floats; Python integers where 64 bits do not hold them."""
    x = np.floor(vectors.astype(np.float64))
    fraction = np.floor((vectors.astype(np.float64) - x) * SCALE)  # exact: a power of two
    if not x.size or np.abs(x).max() < 2 ** 50:
        return (x * SCALE + fraction).astype(np.int64)
    out = np.empty(x.shape, object)
    for at, value in np.ndenumerate(x):
        out[at] = int(value) * SCALE + int(fraction[at])
    return out


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to each entry."""
    most = max(int(abs(a).max()) if a.size else 0 for a in (x, entries))
    if x.shape[1] * 4.0 * float(most) ** 2 < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    a, b = x.astype(object), entries.astype(object)
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


def own_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the entry of the same row."""
    most = max(int(abs(a).max()) if a.size else 0 for a in (x, entries))
    if x.shape[1] * 4.0 * float(most) ** 2 < EXACT:
        return ((x.astype(np.float64) - entries.astype(np.float64)) ** 2).sum(1)
    return ((x.astype(object) - entries.astype(object)) ** 2).sum(1)


def _floor_root(d: np.ndarray) -> np.ndarray:
    """A whole lower bound of the root, below it even after rounding."""
    root = np.sqrt(np.minimum(d, 1e30).astype(np.float64))
    return np.minimum(np.maximum(np.floor(root * (1 - 1e-12)), 0), MOST_BOUND)


def displacements(history: list[np.ndarray], part: int) -> np.ndarray:
    """[stamp, entry]: distance from where an entry stood at the stamp to where it stands now."""
    now = history[-1][part]
    gone = []
    for then in history:
        d = own_squares(then[part], now)
        gone.append(np.sqrt(np.minimum(d, 1e300).astype(np.float64)) * (1 + 1e-12))
    return np.array(gone).reshape(len(history), -1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple:
    """(codes, squared errors, bounds by group) of the rows of x from all distances."""
    d = squares(x, entries)
    codes = np.argmin(d, axis=1)
    rows = np.arange(len(x))
    errors = d[rows, codes].copy()
    d[rows, codes] = np.inf
    bounds = np.stack([_floor_root(d[:, g: g + GROUP].min(axis=1))
                       for g in range(0, d.shape[1], GROUP)], axis=1)
    return codes, errors, bounds


def rescan(x: np.ndarray, history: list[np.ndarray], part: int, codes: np.ndarray,
           bounds: np.ndarray, stamps: np.ndarray) -> tuple:
    """(codes, errors, bounds, stamps, number of distances) under the newest codebook.

    `bounds[:, g]` is below the distance, at round `stamps[:, g]`, to every entry of group g
    other than `codes`.
    """
    entries, now = history[-1][part], len(history) - 1
    moved = displacements(history, part)
    rows = np.arange(len(x))
    own = own_squares(x, entries[codes])
    best, at = own.copy(), codes.copy()
    upper = np.sqrt(np.minimum(own, 1e300).astype(np.float64)) * (1 + 1e-12)
    bounds, stamps = bounds.astype(np.float64), stamps.copy()
    groups = bounds.shape[1]
    furthest = np.stack([moved[:, g * GROUP: (g + 1) * GROUP].max(axis=1) for g in range(groups)], axis=1)
    computed = len(x)
    fresh = {}  # group -> (rows scanned again, their distances)
    for g in range(groups):
        lowered = bounds[:, g] - furthest[stamps[:, g], g]
        again = rows[lowered <= upper]
        if not len(again):
            continue
        low = g * GROUP
        d = squares(x[again], entries[low: low + GROUP])
        computed += d.size
        fresh[g] = (again, d)
        nearest = np.argmin(d, axis=1)
        found = d[np.arange(len(again)), nearest]
        nearest = nearest + low
        better = (found < best[again]) | ((found == best[again]) & (nearest < at[again]))
        best[again[better]] = found[better]
        at[again[better]] = nearest[better]
    for g, (again, d) in fresh.items():
        low = g * GROUP
        d = d.copy()
        inside = np.flatnonzero((at[again] >= low) & (at[again] < low + GROUP))
        d[inside, at[again[inside]] - low] = np.inf
        bounds[again, g] = _floor_root(d.min(axis=1))
        stamps[again, g] = now
    # the entry that a row leaves is now one of the others of its group, scanned again or not
    left = rows[at != codes]
    if len(left):
        g = codes[left] // GROUP
        lowered = np.floor(bounds[left, g] - furthest[stamps[left, g], g])
        bounds[left, g] = np.maximum(np.minimum(lowered, _floor_root(own[left])), 0)
        stamps[left, g] = now
    return at, best, bounds, stamps, computed


def _matrix(column, kind, width: int) -> np.ndarray:
    """Values of a fixed width in a binary column."""
    if not len(column):
        return np.zeros((0, width), kind)
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix)
    step = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(data),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _vectors(batch) -> np.ndarray:
    column = batch.column("embedding")
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _assign(history: list[np.ndarray], keep: bool):
    """Task that codes vectors under the newest of the codebooks and, for a further round, keeps bounds."""
    parts, entries = len(history[0]), len(history[0][0])
    groups = -(-entries // GROUP)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            size = x.shape[1] // parts
            n = len(x)
            codes = np.zeros((n, parts), np.uint8)
            errors = np.zeros(n, object)
            bounds = np.zeros((n, parts, groups), np.uint16)
            stamps = np.zeros((n, parts, groups), np.uint8)
            if len(history) > 1:
                old = _matrix(batch.column("codes"), np.uint8, parts)
                old_bounds = _matrix(batch.column("bounds"), "<u2", parts * groups).reshape(bounds.shape)
                old_stamps = _matrix(batch.column("stamps"), np.uint8, parts * groups).reshape(stamps.shape)
            for p in range(parts):
                cut = x[:, p * size: (p + 1) * size]
                if len(history) == 1:
                    codes[:, p], e, bounds[:, p] = scan(cut, history[0][p])
                else:
                    codes[:, p], e, bounds[:, p], stamps[:, p], _ = rescan(
                        cut, history, p, old[:, p].astype(np.int64), old_bounds[:, p],
                        old_stamps[:, p].astype(np.int64))
                errors += e.astype(object) if e.dtype == object else e.astype(np.int64)
            if keep:
                state = [_binary(codes), _binary(bounds.reshape(n, -1).astype("<u2")),
                         _binary(stamps.reshape(n, -1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), batch.column("embedding"), *state],
                    ["vec_id", "label", "embedding", "codes", "bounds", "stamps"])
            else:
                fits = pa.array([int(e) if e < 2 ** 63 else None for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), _binary(codes), fits],
                    ["vec_id", "label", "codes", "error"])

    return run


def _sums(parts: int, entries: int):
    """Task: number and sums of the parts of each entry, the sums in limbs of 32 bits."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()),
                        ("limb", pa.int32()), ("value", pa.int64())])

    def run(batches):
        total, counts = None, np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _vectors(batch), _matrix(batch.column("codes"), np.uint8, parts)
            size = x.shape[1] // parts
            if total is None:
                total = np.zeros((parts, entries, size), object)
            small_enough = x.dtype != object and int(np.abs(x).max()) < 2 ** 62 // len(x)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                some = np.zeros((entries, size), np.int64 if small_enough else object)
                np.add.at(some, codes[:, p], x[:, p * size: (p + 1) * size].astype(some.dtype))
                total[p] += some
        if total is None:
            return
        rows = [(p, e, -1, 0, int(n)) for (p, e), n in np.ndenumerate(counts) if n]
        for (p, e, i), value in np.ndenumerate(total):
            value, limb = int(value), 0
            while value:  # of a negative sum the last limb is -1
                last = -2 ** LIMB <= value < 2 ** LIMB
                rows.append((p, e, i, limb, value if last else value & (2 ** LIMB - 1)))
                value, limb = 0 if last else value >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                                         schema=schema)

    return run


def moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook with every used entry at the floor of its parts' mean."""
    parts, entries, size = book.shape
    found = state.select("embedding", "codes").mapInArrow(
        _sums(parts, entries), "part int, entry int, place int, limb int, value long").groupBy(
        "part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    sums, counts = np.zeros(book.shape, object), np.zeros((parts, entries), object)
    for r in found.collect():  # parts * entries * (size + 1) rows, times the limbs of the largest sum
        if r.place < 0:
            counts[r.part, r.entry] = r.value
        else:
            sums[r.part, r.entry, r.place] += r.value << (LIMB * r.limb)
    out = book.astype(object)
    for (p, e), n in np.ndenumerate(counts):
        if n:
            out[p, e] = [s // n for s in sums[p, e]]
    return _narrow(out)


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(-2 ** 62 < v < 2 ** 62 for v in book.flat) else book


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in book.flat).encode()).hexdigest()


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and embedding of the vectors that can be coded."""
    fine = vectors.select("vec_id", "label", "embedding").filter(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(
            ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    first = fine.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(
        F.size("embedding").alias("n")).first()
    size = first.n if first else 0
    return fine.filter((F.size("embedding") == size) & F.lit(size > 0 and size % parts == 0))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """State of the vectors after the last round and the codebooks of all rounds.

    The state holds codes, bounds and stamps made under the codebook before the last.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    first = vectors.filter("vec_id IS NOT NULL").orderBy("vec_id", "embedding").limit(
        entries).select("embedding").collect()  # at most 256 rows
    if not first:
        return vectors, []
    start = whole(np.array([r.embedding for r in first]))
    book = start.reshape(len(first), parts, -1).transpose(1, 0, 2)
    history, state = [np.ascontiguousarray(book)], vectors
    kinds = dict(vectors.dtypes)
    schema = (f"vec_id {kinds['vec_id']}, label {kinds['label']}, embedding {kinds['embedding']}, "
              "codes binary, bounds binary, stamps binary")
    for i in range(rounds):
        state = written(state.mapInArrow(_assign(history, True), schema), f"codes-round{i}")
        history.append(moved(state, history[-1]))
    return state, history


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every usable vector."""
    vectors = usable(vectors, parts)
    state, history = train(vectors, parts, entries, rounds)
    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long"
    if not history:
        none = vectors.filter(F.lit(False)).select(
            "vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(0).cast("long").alias("error"))
        return _with_label_errors(none, "")
    coded = written(state.mapInArrow(_assign(history, False), schema), "codes-final")
    return _with_label_errors(coded, digest(history[-1]))


def _with_label_errors(coded: DataFrame, sha256: str) -> DataFrame:
    by_label = coded.groupBy("label").agg(
        F.when(F.count(F.lit(1)) == F.count("error"),
               F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS long)")).alias("label_error"))
    if sha256:
        by_label = small(written(by_label, "codes-labels"))
    by_label = by_label.withColumnRenamed("label", "of_label")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of_label"]), "left").select(
        "vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(sha256).alias("codebooks_sha256"))
