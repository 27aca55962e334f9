"""N-gram Jaccard self-join by signature trees, exact, with the groups that the links form.

A document is the set of its word n-grams.  Two link when the Jaccard similarity of their
sets reaches a threshold.

1. Documents with equal sets are one class, found by a digest of the set.
2. Classes that can link are brought together: the n-grams are dealt by hash into M parts,
   M a little more than the number of differences that a pair may have, so that at least
   one part is equal in both.  Of a set's parts those of most n-grams are sent, one more than
   can differ.  Equal parts make candidate edges, their components are candidate groups.  M comes from a ladder of values by set size; a class takes part at each M
   that a partner's size may have.  No pair above the threshold is missed.
3. A candidate group (cut into blocks of bounded size where it is large) is joined with a
   signature tree: leaves are token bitmaps with set sizes, inner nodes hold the OR of their
   children's bitmaps and the range of their sizes.  A dual traversal descends only into node
   pairs whose greatest possible overlap reaches the threshold, and skips pairs that are
   connected already, so that a group of near copies costs about its length, not its square.
   Surviving leaf pairs are verified on the sets.
   A document's block follows from its least n-gram, as like documents mostly share it;
   one that very many share is dealt over several blocks.  A few of its documents are copied
   to all of these (and those of a group's commonest to all its blocks), so that the parts
   of near copies are linked already.
4. Blocks of one group meet only for the documents outside the group's largest connected
   part, and only where sizes allow a link.

Texts are read three times (sizes and digests; signatures; sets of candidates) and shuffled only
where the list of candidates is too long to broadcast.  No task holds a candidate group, only
blocks; nothing is collected to the driver.

Defined results: a null text, or one without words, has an empty set and links with
nothing; fewer words than n make one n-gram of them all; repeated rows have equal sets and are
one class; a null doc_id is never the id of a group (alone, it has none); rows of one
doc_id with different texts share an id and its group.  An empty table gives no rows.
`keep_first` keeps all columns, rows with a null doc_id, and repeated rows of what stays;
elsewhere other columns are left out.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pennywright.llm.components import components
from pennywright.llm.shared import small, written

BITS = 2048  # of a token bitmap
FANOUT = 8
BLOCK = 1_000_000  # n-grams of a block
KNOWN = 100_000  # words whose hashes a task keeps
HELD = 4_000_000  # bytes of sets that a task takes or sends at once
COMBINED = 500_000  # signatures, about, that a task combines
BATCH = 65_536  # rows of signatures sent at once
PIVOTS = 8  # documents, at most, that all blocks of a least n-gram have
RUNG = 1.6  # ratio of the ladder of part counts


# ---- sets -------------------------------------------------------------------------------


class Hashes(dict):
    """Hashes of words by word, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Distinct n-gram hashes (64 bit, sorted) of texts, one text after the other.

    No more is held than the words of one text and KNOWN hashes.
    """

    def __init__(self, n: int):
        self.n = n
        self.known = Hashes()

    def __call__(self, texts):
        for text in texts:
            words = (text or "").encode().lower().split()
            yield self._grams(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))

    def _grams(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        n = min(self.n, len(h))
        size = len(h) - n + 1
        out = np.full(size, n, np.uint64)
        for i in range(n):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i: i + size])
        return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ladder:
    """Part counts for set sizes at a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differences(self, smaller: int) -> int:
        """The most differences of a linked pair whose smaller set has this size."""
        return smaller * (self.den - self.num) // self.num

    def parts(self, differences: int) -> int:
        """The rung at or above 1.1 * differences + 4."""
        least = 1.1 * differences + 4
        return math.ceil(RUNG ** math.ceil(math.log(least) / math.log(RUNG)))

    def rungs(self, size: int) -> list[int]:
        """Part counts at which a set of this size meets its possible partners."""
        lowest = -(-size * self.num // self.den)
        if self.differences(size) == 0:
            return []  # links to equal sets only
        low, high = (self.parts(self.differences(s)) for s in (lowest, size))
        out = [low]
        while out[-1] < high:
            step = math.log(out[-1] + 0.5) / math.log(RUNG)
            out.append(math.ceil(RUNG ** (math.floor(step) + 1)))
        return out

    def equal_parts(self, parts: int) -> int:
        """At least so many parts are equal in a linked pair that meets at this rung."""
        return parts - int((parts - 4) / 1.1)

    def unequal_parts(self, parts: int, size: int) -> int:
        """At most so many parts of a set differ from those of a partner that it meets at this rung."""
        return min(self.differences(size), int((parts - 4) / 1.1 + 1e-6))


def part_signatures(grams: np.ndarray, ladder: Ladder) -> np.ndarray:
    """Hashes of parts of a set, for each rung one more than can differ from a partner's.

    These are of the parts of most n-grams, which other sets have least by chance, then least
    hash: an order in which equal parts have one place, so that the first part that two sets
    share is among them, as no more than can differ come before it in either.  An empty part counts
    only if the set has so many that all equal parts could be empty; then all parts are given.
    """
    out = []
    for parts in ladder.rungs(len(grams)):
        at = (grams % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, _mixed(grams ^ np.uint64(parts)))  # order does not matter
        sizes = np.bincount(at, minlength=parts)
        keep = sizes > 0
        least = ladder.unequal_parts(parts, len(grams)) + 1
        if parts - int(keep.sum()) >= ladder.equal_parts(parts):
            keep[:] = True
            least = parts
        where = np.flatnonzero(keep).astype(np.uint64)
        tag = where * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(parts)
        found = _mixed(sums[keep] + _mixed(tag))
        if least < len(found):
            found = found[np.lexsort((found, -sizes[keep]))[:least]]
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# ---- signature tree ---------------------------------------------------------------------


class Links:
    """Union-find over the items of one or two trees."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class SignatureTree:
    """Levels of nodes over items; level 0 is the items in an order that puts like ones together."""

    def __init__(self, sets: list[np.ndarray], first: int = 0):
        sizes = np.array([len(s) for s in sets])
        order = np.lexsort(([s[0] for s in sets], np.floor(np.log2(sizes) * 4)))
        self.items = [int(i) + first for i in order]
        self.sets = [sets[i] for i in order]
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for row, s in zip(bits, self.sets):
            at = np.unique(s & np.uint64(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        low = high = sizes[order]
        # tokens beyond the first on a bit: they may overlap unseen by the bitmap
        extra = low - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, low, high, extra)]
        while len(bits) > 1:
            starts = np.arange(0, len(bits), FANOUT)
            bits = np.bitwise_or.reduceat(bits, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            extra = np.maximum.reduceat(extra, starts)
            self.levels.append((bits, low, high, extra))

    def below(self, level: int, node: int) -> range:
        """Children of a node, on the level below."""
        size = len(self.levels[level - 1][1])
        return range(node * FANOUT, min((node + 1) * FANOUT, size))

    def covered(self, level: int, node: int) -> range:
        width = FANOUT ** level
        return range(node * width, min((node + 1) * width, len(self.items)))


def _may_link(x, xs, y, ys, num: int, den: int) -> np.ndarray:
    """Matrix of node pairs whose greatest possible overlap reaches the threshold."""
    (xb, xl, xh, xe), (yb, yl, yh, ye) = ([a[s] for a in lv] for lv, s in ((x, xs), (y, ys)))
    common = np.bitwise_count(xb[:, None, :] & yb[None, :, :]).sum(2).astype(np.int64)
    most = common + np.minimum(xe[:, None], ye[None, :])
    most = np.minimum(most, np.minimum(xh[:, None], yh[None, :]))
    return (num + den) * most >= num * (xl[:, None] + yl[None, :])


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b| for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def traverse(x: SignatureTree, y: SignatureTree, links: Links, num: int, den: int) -> None:
    """Link all items of two trees (or of one with itself) that reach the threshold."""
    same = x is y
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    find = links.find
    while stack:
        i, p, j, q = stack.pop()
        if i == 0 and j == 0:
            a, b = x.items[p], y.items[q]
            if not (same and p == q) and find(a) != find(b) and linked(
                    x.sets[p], y.sets[q], num, den):
                links.join(a, b)
            continue
        one = {find(x.items[k]) for k in x.covered(i, p)}
        if len(one) == 1 and one == {find(y.items[k]) for k in y.covered(j, q)}:
            continue
        ps = x.below(i, p) if i >= j and i else range(p, p + 1)
        qs = y.below(j, q) if j >= i and j else range(q, q + 1)
        il, jl = (i - 1 if i >= j and i else i), (j - 1 if j >= i and j else j)
        rows, columns = slice(ps.start, ps.stop), slice(qs.start, qs.stop)
        ok = _may_link(x.levels[il], rows, y.levels[jl], columns, num, den)
        if same and i == j and p == q:  # own children: each pair once, own pairs last on the stack
            ok = np.triu(ok, 1)
            stack += [(il, ps[r], jl, qs[c]) for r, c in zip(*np.nonzero(ok))]
            stack += [(il, r, jl, r) for r in ps if il]
        else:
            stack += [(il, ps[r], jl, qs[c]) for r, c in zip(*np.nonzero(ok))]


def links_of_block(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the least index that it is linked to, through others too."""
    links = Links(len(sets))
    if len(sets) == 2:
        if linked(*sets, num, den):
            links.join(0, 1)
    elif len(sets) > 2:
        tree = SignatureTree(sets)
        traverse(tree, tree, links, num, den)
    return [links.find(i) for i in range(len(sets))]


# ---- the join on Spark ------------------------------------------------------------------


def _texts(batch: pa.RecordBatch):
    """Texts of a batch one by one: as Python strings they may take four times the batch."""
    return (t.as_py() for t in batch.column("text"))


def _slices(batch: pa.RecordBatch, sizes):
    """The batch in runs of rows of HELD bytes or, where a row is larger, of one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > HELD:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _sliced(batches):
    """Batches with a column grams in slices, so that few sets are Python values at once."""
    for batch in batches:
        yield from _slices(batch, pc.binary_length(batch.column("grams")).to_pylist())


def _groups(batches, keys: list[str], unique: str):
    """Runs of rows with equal keys, as lists of column values, from sorted Arrow batches.

    Of consecutive rows with one value of `unique` in a run the first counts.
    """
    held, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = [batch.schema.get_field_index(k) for k in keys]
        one = batch.schema.get_field_index(unique)
        for values in zip(*columns):
            key = tuple(values[i] for i in at)
            if rows and key == held and rows[-1][one] == values[one]:
                continue
            if key != held and rows:
                yield held, rows
                rows = []
            held = key
            rows.append(values)
    if rows:
        yield held, rows


def _edges(links) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def sized(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its first 64 bits (null for an empty set)."""
    def run(batches):
        shingle = Shingler(n)
        for batch in batches:
            sizes, digests = [], []
            for grams in shingle(_texts(batch)):
                sizes.append(len(grams))
                digests.append(_digest(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(map(_short, digests), pa.int64())],
                ["doc_id", "n_shingles", "digest", "short"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, short long")


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _short(digest: bytes | None) -> int | None:
    return None if digest is None else int.from_bytes(digest[:8], "little", signed=True)


def signature_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """sig, short, a: part signatures of each set, combined for the sets of about COMBINED.

    These have one row per signature, its least set, without a; every other set of the
    signature is an edge (a, short) to it, once, under a sig of its own.
    """
    ladder = Ladder(num, den)

    def run(batches):
        shingle = Shingler(n)
        seen, signatures, shorts, held = set(), [], [], 0
        for grams in (g for batch in batches for g in shingle(_texts(batch))):
            found = part_signatures(grams, ladder)
            short = _short(_digest(grams)) if len(found) else None
            if len(found) and short not in seen:
                seen.add(short)
                signatures.append(found.view(np.int64))
                shorts.append(np.full(len(found), short, np.int64))
                held += len(found)
            if held >= COMBINED:
                yield from combined(signatures, shorts)
                seen, signatures, shorts, held = set(), [], [], 0
        if held:
            yield from combined(signatures, shorts)

    def combined(signatures, shorts):
        sigs, sets = np.concatenate(signatures), np.concatenate(shorts)
        signatures.clear()
        shorts.clear()
        rows = _combined(sigs, sets)
        del sigs, sets
        for i in range(0, rows.num_rows, BATCH):
            yield rows.slice(i, BATCH)

    return docs.select("text").mapInArrow(run, "sig long, short long, a long")


def _combined(sigs: np.ndarray, shorts: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((shorts, sigs))
    sigs, shorts = sigs[order], shorts[order]
    head = np.r_[True, sigs[1:] != sigs[:-1]]
    starts = np.flatnonzero(head)
    rest = np.flatnonzero(~head)
    least = shorts[starts[np.searchsorted(starts, rest) - 1]]
    edges = pd.DataFrame({"a": least, "b": shorts[rest]}).drop_duplicates()
    edges = edges[edges["a"] != edges["b"]]
    a, b = edges["a"].to_numpy(), edges["b"].to_numpy()
    own = _mixed(_mixed(a.view(np.uint64)) + b.view(np.uint64)).view(np.int64)
    heads = int(head.sum())
    sigs, shorts = sigs[head], shorts[head]
    order = np.argsort(shorts, kind="stable")  # rows of a set one after the other compress better
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[sigs[order], own]), pa.array(np.r_[shorts[order], b]),
         pa.array(np.r_[np.zeros(heads, np.int64), a], mask=np.arange(heads + len(a)) < heads)],
        ["sig", "short", "a"])


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """Replace column text by grams (packed 64-bit hashes) and first (the least)."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches):
        shingle = Shingler(n)
        for batch in batches:
            # a text of b bytes has b / 2 words at most, and a set 8 bytes for each
            sizes = pc.multiply(pc.fill_null(pc.binary_length(batch.column("text")), 0), 4)
            for part in _slices(batch, sizes.to_pylist()):
                sets = list(shingle(_texts(part)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([int(s[0].view(np.int64)) for s in sets], pa.int64())],
                    [*kept, "grams", "first"])

    kinds = dict(texts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept)
    return texts.mapInArrow(run, schema + ", grams binary, first long")


def in_blocks(sets: DataFrame) -> DataFrame:
    """team, block, rep, grams of written rows that also have blocks, size and first.

    The rows of a least n-gram go to one block, or to as many as they fill.
    """
    firsts = sets.filter("blocks > 1").groupBy("team", "first").agg(
        F.first("blocks").alias("blocks"), F.sum("size").alias("n"), F.array_distinct(F.array(
            *[F.min_by("rep", F.xxhash64("rep", F.lit(i))) for i in range(PIVOTS)])).alias("pivots"))
    firsts = written(firsts.withColumn("rooms", F.ceil(F.col("n") / BLOCK).cast("int")), "join-firsts")
    hot = firsts.filter("rooms > 1")
    home = F.pmod(F.xxhash64("first"), F.col("blocks"))
    dealt = sets.join(small(hot.select("team", "first", "rooms")), ["team", "first"], "left")
    salt = F.pmod(F.xxhash64("rep"), F.coalesce("rooms", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(home + salt, F.col("blocks")).cast("int"))
    rooms = F.sequence(F.lit(0), F.col("rooms") - 1)
    own = hot.select("team", "pivots", F.transform(
        rooms, lambda i: F.pmod(home + i, F.col("blocks")).cast("int")).alias("to"))
    common = firsts.groupBy("team").agg(
        F.max_by(F.struct("pivots", "blocks"), F.struct("n", "first")).alias("c"))
    common = common.select("team", "c.pivots", F.sequence(F.lit(0), F.col("c.blocks") - 1).alias("to"))
    copies = own.unionByName(common).select("team", F.explode("pivots").alias("rep"), "to")
    copies = copies.select("team", "rep", F.explode("to").alias("block")).distinct()
    copied = sets.select("team", "rep", "grams").join(
        small(written(copies, "join-pivots")), ["team", "rep"])
    columns = ["team", "block", "rep", "grams"]
    return dealt.select(columns).unionByName(copied.select(columns))


def _links_in_blocks(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) inside each (team, block) of rows rep, grams."""
    def run(batches):
        for _, rows in _groups(_sliced(batches), ["team", "block"], "rep"):
            if len(rows) > 1:
                sets = [np.frombuffer(r[3], np.uint64) for r in rows]
                found = links_of_block(sets, num, den)
                edges = [(rows[k][2], rows[i][2]) for i, k in enumerate(found) if k != i]
                if edges:
                    yield _edges(edges)

    dealt = blocks.select("team", "block", "rep", "grams").repartition(
        "team", "block").sortWithinPartitions("team", "block", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def _links_across(teams: DataFrame, part: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between blocks, for teams of several blocks.

    teams: team, blocks, rep, size, grams; part: rep, label so far.  Documents outside the
    largest label of their team are the query side, cut into blocks by size bin and
    hash; every document of the team goes to the query blocks whose sizes it can link to.
    """
    names = teams.select("team", "rep", "size").join(part, "rep", "left").withColumn(
        "label", F.coalesce("label", "rep"))
    sums = names.groupBy("team", "label").agg(F.sum("size").alias("n"))
    main = sums.groupBy("team").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    # labels are narrow: sets are not shuffled for them where they fit a broadcast
    names = written(names.join(main, "team").select("team", "rep", "label", "main").distinct(),
                    "join-labels")
    rows = teams.join(small(names), ["team", "rep"]).withColumn("bin", F.floor(
        F.log("size") / F.log(F.lit(den / num))).cast("int"))
    asking = rows.filter("label <> main")
    # one narrow row for each team and size bin: sets are not shuffled to find their rooms either
    rooms = small(written(asking.groupBy("team", "bin").agg(
        F.ceil(F.sum("size") / BLOCK).cast("int").alias("rooms")), "join-rooms"))
    room = F.pmod(F.xxhash64("rep"), F.col("rooms")).cast("int")
    left = asking.join(rooms, ["team", "bin"]).select(
        "team", "bin", room.alias("room"), F.lit(0).alias("side"), "rep", "label", "grams")
    # of two on the query side, the one in the lower bin goes to the other's
    at = F.col("bin")
    bins = F.when(F.col("label") != F.col("main"), F.array(at, at + 1)).otherwise(
        F.array(at - 1, at, at + 1))
    near = rows.select("team", "rep", "label", "grams", F.explode(bins).alias("bin"))
    right = near.join(rooms, ["team", "bin"]).select(
        "team", "bin", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"),
        F.lit(1).alias("side"), "rep", "label", "grams")

    def run(batches):
        held, asked, tree, labels, links = None, [], None, [], []

        def against(rows):
            """A piece of the other side against the tree of the query side."""
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            both = labels + [r[4] for r in rows]
            join = Links(len(both))
            seen: dict = {}
            for i, label in enumerate(both):  # equal labels are linked already
                join.join(seen.setdefault(label, i), i)
            before = [join.find(i) for i in range(len(both))]
            traverse(tree, SignatureTree(sets, len(labels)), join, num, den)
            return [(both[join.find(i)], both[i]) for i in sorted(set(before)) if join.find(i) != i]

        def pieces():
            """Rows in order, cut where the key or side changes and at a bounded size."""
            rows, size, held = [], 0, None
            for batch in _sliced(batches):
                for values in zip(*[c.to_pylist() for c in batch.columns]):
                    key = values[:3] + (values[6],)
                    full = values[6] == 1 and size >= 8 * BLOCK
                    if rows and key == held and rows[-1][3] == values[3]:
                        continue  # a repeated row
                    if rows and (key != held or full):
                        yield held, rows
                        rows, size = [], 0
                    held = key
                    rows.append(values)
                    size += len(values[5])
            if rows:
                yield held, rows

        for key, rows in pieces():
            if key[3] == 0:
                held, asked = key[:3], rows
                tree = SignatureTree([np.frombuffer(r[5], np.uint64) for r in rows])
                labels = [r[4] for r in rows]
            elif key[:3] == held:
                links = against(rows)
                if links:
                    yield _edges(links)

    dealt = left.unionByName(right).select("team", "bin", "room", "rep", "label", "grams", "side")
    dealt = dealt.repartition("team", "bin", "room").sortWithinPartitions(
        "team", "bin", "room", "side", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def join_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`.

    component_id is the smallest doc_id that links reach.
    """
    rows = written(sized(docs, n), "join-rows")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"),
        F.first("short").alias("short"))
    classes = written(classes, "join-classes")
    # a group of equal parts is a star around its least member, which the window carries on;
    # batches are combined, so that the window has at most one row of a part for each
    order = Window.partitionBy("sig").orderBy("short").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    stars = signature_rows(docs, n, num, den).withColumn(
        "a", F.coalesce("a", F.first("short").over(order))).filter("a <> short")
    teams = components(stars.select("a", F.col("short").alias("b")))
    teams = teams.select(F.col("node").alias("short"), F.col("component").alias("team"))
    members = teams.join(classes, "short").filter("rep IS NOT NULL").select("team", "rep", "size")
    blocks = members.groupBy("team").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    members = written(members.join(blocks, "team"), "join-members")
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("rep"), "text")
    # rows of one doc_id may differ in text: the one of the class has its number of n-grams
    sets = sets_of(texts.join(small(members), "rep").select(
        "team", "blocks", "rep", "size", "text"), n)
    sets = written(sets.filter(F.length("grams") == F.col("size") * 8), "join-sets")
    large = sets.filter("blocks > 1").select("team", "blocks", "rep", "size", "grams")
    several = large.limit(1).count() > 0
    blocks = in_blocks(sets) if several else sets.withColumn("block", F.lit(0))
    inside = written(_links_in_blocks(blocks, num, den), "join-links")
    if several:
        label = components(inside).select(F.col("node").alias("rep"), F.col("component").alias("label"))
        across = _links_across(large, label, num, den)
        inside = written(inside.union(across), "join-all-links")
    found = components(inside).select(F.col("node").alias("rep"), F.col("component").alias("found"))
    named = classes.join(found, "rep", "left").select(
        "digest", F.coalesce("found", "rep").alias("component"))
    return rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of `docs` without documents whose group has one of smaller doc_id; all columns."""
    found = join_groups(docs, n, num, den).filter("component_id < doc_id")
    gone = written(found.select(F.col("doc_id").alias("__nj_gone")).distinct(), "join-gone")
    return docs.join(small(gone), F.col("doc_id") == F.col("__nj_gone"), "left_anti")
