import collections
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pennywright.llm import filter_audit as fa, vector_codes as vc
from tests.llm import brute

# --- filter interaction audit


def plain_audit(rows, labels):
    """(part, order, step) -> the eight counts; rows are (doc_id, text, lang)."""
    known = collections.defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            known[i] = [max(known[i][0], q == 1), max(known[i][1], t == 1)]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failed = collections.defaultdict(list)
    for i, t, lang in rows:
        text, ws = t or "", brute.words(t)
        f = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws),
             "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
             "D": any(c in "#$%&*|" for c in text), "E": i is not None and first[text] < i}
        failed[lang or ""].append(({k for k, v in f.items() if v}, known[i] if i is not None else [0, 0]))
    out, share = {}, collections.Counter()
    for part, docs in failed.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[part, f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in d[0] for d in docs) - len(gone),
                    sum(d[0] == {f} for d in docs), sum(d[1][0] for d in gone), sum(d[1][1] for d in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_matches_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    labels = [(i * 3, i % 2, int(i % 5 == 0)) for i in range(40)] + [(3, 0, 0), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(rows, labels)
    for block in (fa.BLOCK, 3):
        got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS)
               for r in fa.audit(docs, frame, block=block).collect()}
        assert got == want


def test_audit_of_an_empty_table_and_of_another_part(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(no_docs, labels).count() == 0
    got = fa.audit(docs, labels, part=F.lit(1), conditions={"A": "n_words < 100"}).collect()
    assert {(r.part, r.filter_order, r.step) for r in got} == {("1", o, s) for o in ("AE", "EA") for s in (1, 2)}
    assert all(r.good_lost == 0 for r in got)


def test_parts_that_hold_most_rows_are_cut_into_ranges(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 10 else "de") for i in range(3000)] + [(5, "x", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 3000, 2)], "doc_id long, quality int, toxic int")
    want = plain_audit(rows, [(i, 1, 0) for i in range(0, 3000, 2)])
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS)
           for r in fa.audit(docs, labels, block=200).collect()}
    assert got == want


ids = st.lists(st.integers(0, 400), unique=True).map(lambda x: np.array(sorted(x), np.int64))


@settings(max_examples=200, deadline=None)
@given(st.lists(ids, max_size=5), ids, st.sampled_from([1, 7, 64, 16_384]))
def test_merges_of_posting_lists(lists, right, width):
    assert fa.union(lists, width).tolist() == sorted(set().union(*[set(x.tolist()) for x in lists]))
    for left in lists:
        assert fa.difference(left, right, width).tolist() == sorted(set(left.tolist()) - set(right.tolist()))


@settings(max_examples=200, deadline=None)
@given(ids, st.integers(-5, 410), st.integers(0, 5))
def test_gallop_finds_the_first_place(a, value, at):
    at = min(at, len(a))
    want = next((i for i in range(at, len(a)) if a[i] >= value), len(a))
    assert fa.gallop(a, value, at) == want


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    """[(vec_id, code, error)] and the last codebook, with Python's integers only."""
    kept = [(i, [math.floor(256 * float(x)) if abs(x) < 2 ** 40 else int(x) * 256 for x in v]) for i, v in rows]
    size = len(kept[0][1]) // parts
    firsts = sorted((r for r in kept if r[0] is not None))[:entries]
    book = [[v[p * size: p * size + size] for _, v in firsts] for p in range(parts)]

    def nearest(cut, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut, e)), j) for j, e in enumerate(book[p]))

    def assigned():
        return [[nearest(v[p * size: p * size + size], p) for p in range(parts)] for _, v in kept]

    for _ in range(rounds):
        codes = assigned()
        for p in range(parts):
            for j in range(len(firsts)):
                members = [v[p * size: p * size + size] for (_, v), c in zip(kept, codes) if c[p][1] == j]
                if members:
                    book[p][j] = [sum(x) // len(members) for x in zip(*members)]
    return [(i, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c))
            for (i, _), c in zip(kept, assigned())], book


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, size))
    return [(i, (centres[i % 5] + rng.normal(0, 0.3, size)).astype(np.float32).tolist()) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, codes string, part int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, (i or 0) % 3 or None, "x", 1) for i, v in rows], schema).repartition(3)


def check(spark, rows, want_rows, schema=SCHEMA, parts=4, entries=20, rounds=3):
    got = vc.compress(frame(spark, rows, schema), parts, entries, rounds).collect()
    want, book = plain_codes(want_rows, parts, entries, rounds)
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} == {vc.digest(np.array(book, dtype=object))}
    sums = collections.Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got)


def test_codes_match_brute_force(spark):
    rows = vectors(150, 24, 1)
    rows += [rows[3], (7, rows[9][1]), (200, rows[4][1]), (None, rows[5][1])]  # repeats, ties, no id
    bad = [(300, None), (301, [None] * 24), (302, [float("nan")] + [0.0] * 23),
           (303, [float("inf")] + [0.0] * 23), (304, [1.0] * 20), (305, [])]
    check(spark, rows + bad, rows)


def test_codes_of_huge_components_are_exact(spark):
    rows = vectors(60, 8, 2)
    rows[3] = (3, [float(np.float32(3e30))] * 4 + [-5e7] * 4)
    rows[40] = (40, [float(np.float32(-1e25))] * 8)
    got = vc.compress(frame(spark, rows), 4, 10, 2).collect()
    want, book = plain_codes(rows, 4, 10, 2)
    assert {r.vec_id: r.code for r in got} == {i: c for i, c, _ in want}
    for r, e in zip(sorted(got), sorted(want)):
        assert r.error == (e[2] if e[2] < 2 ** 63 else None)
    assert {r.codebooks_sha256 for r in got} == {vc.digest(np.array(book, dtype=object))}


def test_fewer_vectors_than_entries_other_types_and_nothing(spark):
    rows = vectors(9, 16, 3)
    check(spark, rows, rows, "vec_id int, embedding array<double>, label string, codes string, part int")
    assert vc.compress(frame(spark, []), 4, 10, 2).count() == 0
    assert vc.compress(frame(spark, rows), 5, 10, 2).count() == 0  # 16 components, five parts
    nameless = vc.compress(frame(spark, [(None, v) for _, v in rows]), 4, 10, 2)
    assert nameless.count() == 0  # no first codebook


@pytest.mark.parametrize("seed", range(4))
def test_bounds_skip_most_distances_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 400, (3000, 6)).round().astype(np.int64)
    x[1000:] = (x[rng.integers(0, 8, 2000)] + rng.normal(0, 20, (2000, 6))).astype(np.int64)
    history = [x[None, :64].copy()]
    codes, _, bounds = vc.scan(x, history[0][0])
    stamps = np.zeros(bounds.shape, np.int64)
    computed = 0
    for _ in range(6):
        book = history[-1].copy()
        for j in np.unique(codes):
            book[0, j] = x[codes == j].sum(0) // (codes == j).sum()
        history.append(book)
        codes, errors, bounds, stamps, n = vc.rescan(x, history, 0, codes, bounds, stamps)
        full = vc.squares(x, book[0])
        assert (codes == full.argmin(1)).all() and (errors == full.min(1)).all()
        others = full.copy()
        others[np.arange(len(x)), codes] = np.inf
        computed += n
    assert computed < 0.6 * 6 * x.shape[0] * 64
    assert len(np.unique(stamps)) > 1  # bounds of several rounds are in use


def test_net_moves_are_tighter_than_the_sum_of_moves():
    there, away = np.zeros((1, 1, 2), np.int64), np.full((1, 1, 2), 50)
    net = vc.displacements([there, away, there], 0)[:, 0]
    assert net[0] == 0 and net[1] > 70
