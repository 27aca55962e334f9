import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pennywright.llm import ngram_join as nj, suffix_dedup as sd, winnowing as wn
from tests.llm import brute


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_groups_match_brute_force(docs, corpus, n, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join_groups(docs, n, num, den).collect()}
    alone = got.pop(None)
    assert alone[1] is None
    assert got == brute.groups([r for r in set(corpus) if r[0] is not None], n, num, den)


def test_groups_cut_into_blocks_match_brute_force(docs, corpus, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 150)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in nj.join_groups(docs.filter("doc_id is not null"), 3, 70, 100).collect()}
    assert got == brute.groups([r for r in set(corpus) if r[0] is not None], 3, 70, 100)


def test_first_of_each_group_stays(docs, corpus):
    kept = nj.keep_first(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    want = brute.groups([r for r in set(corpus) if r[0] is not None], 5, 80, 100)
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i][1] == i} | {None}


def test_signatures_meet_for_every_pair_above_the_threshold():
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100)):
        ladder = nj.Ladder(num, den)
        for size in (9, 10, 12, 25, 60, 150, 400, 2000):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            for drop in range(0, ladder.differences(len(a)) + 1, max(1, size // 40)):
                b = a[np.sort(rng.permutation(len(a))[drop:])]
                if nj.linked(a, b, num, den) and drop:
                    assert set(nj.part_signatures(a, ladder).tolist()) & set(
                        nj.part_signatures(b, ladder).tolist())


def test_a_set_sends_one_signature_more_than_parts_can_differ():
    rng = np.random.default_rng(4)
    ladder = nj.Ladder(80, 100)
    for size in (40, 120, 310, 900, 4000):
        grams = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        sent = len(nj.part_signatures(grams, ladder))
        assert sent <= len(ladder.rungs(size)) * (ladder.differences(size) + 1)
        for small in range(-(-size * 80 // 100), size + 1):  # sizes of partners
            rung = ladder.parts(ladder.differences(small))
            assert rung in ladder.rungs(size)
            assert ladder.unequal_parts(rung, size) >= ladder.differences(small)


def test_rows_of_a_set_are_sent_one_after_the_other():
    sigs = np.array([5, 1, 3, 2, 4, 6], np.uint64)
    rows = nj._combined(sigs, np.array([7, 7, 8, 8, 7, 8])).to_pydict()
    assert rows["short"] == [7, 7, 7, 8, 8, 8] and rows["sig"] == [1, 4, 5, 2, 3, 6]


def test_sets_are_not_shuffled_to_find_their_rooms(spark):
    grams = np.arange(50, dtype=np.uint64).tobytes()
    teams = spark.createDataFrame(
        [(1, 2, r, 50 + r % 9, grams) for r in range(40)],
        "team long, blocks int, rep long, size long, grams binary")
    label = spark.createDataFrame([(r, 0) for r in range(20)], "rep long, label long")
    plan = nj._links_across(teams, label, 80, 100)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)


def test_tree_finds_all_links():
    rng = random.Random(2)
    for _ in range(10):
        sets = []
        for _ in range(60):
            base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.6 else np.array(
                rng.sample(range(10**9), 40), np.uint64)
            changed = base.copy()
            changed[: rng.randrange(6)] = rng.randrange(10**9)
            sets.append(np.unique(changed))
        got = nj.links_of_block(sets, 85, 100)
        want = brute_links(sets, 85, 100)
        assert got == want


def brute_links(sets, num, den):
    up = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j in range(i):
                if nj.linked(a, sets[j], num, den):
                    up[i] = up[j] = min(up[i], up[j])
    return up


def test_empty_tables(no_docs):
    assert nj.join_groups(no_docs).count() == 0
    assert nj.keep_first(no_docs).count() == 0
    assert sd.digest_repeats(no_docs).count() == 0
    assert sd.remove_repeats(no_docs).count() == 0
    assert wn.compare_edited(no_docs).count() == 0


@pytest.mark.parametrize("hot,batch", [(10**6, 10**6), (1, 300)])
def test_removed_bytes_match_brute_force(docs, corpus, hot, batch):
    rows = {r for r in corpus if r[0] is not None}
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in sd.digest_repeats(docs.filter("doc_id is not null"), hot=hot, batch_bytes=batch).collect()}
    flags = brute.removed(rows, 100)
    assert got == {(i, *brute.digest(t, flags[i])) for i, t in rows}


def test_narrow_windows_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in sd.digest_repeats(df, width=12, k=4).collect()}
    flags = brute.removed(rows, 12)
    assert got == {i: brute.digest(t, flags[i]) for i, t in rows}


def test_text_is_cut_at_whole_characters(docs, corpus):
    kept = sd.remove_repeats(docs)
    assert kept.columns == docs.columns
    flags = brute.removed({r for r in corpus if r[0] is not None}, 100)
    by_id = {r.doc_id: r for r in kept.collect()}
    for i, text in corpus:
        if i is None or not (text or "").strip(" \t\n\x0b\x0c\r"):
            continue
        left = sum(not f for f in flags[i])
        if i in by_id:
            row = by_id[i]
            assert left <= len(row.text.encode()) <= left + 6 * 8 and row.n_chars == len(row.text)
        else:
            assert left < 8




def test_fingerprints(docs, corpus):
    rows = [r.asDict() for r in wn.compare_edited(docs).collect()]
    assert len(rows) == len(corpus)
    by_text = {}
    texts = {i: t or "" for i, t in corpus}
    order = sorted((i for i in texts if i is not None))
    nexts = dict(zip(order, order[1:]))
    import hashlib
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_chars"] == len(text)
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] in nexts and corpus.count((r["doc_id"], texts[r["doc_id"]])) == 1:
            half = len(text) // 2
            edited = text[: len(text) - half] + texts[nexts[r["doc_id"]]][:half]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (r["edited_fingerprint"] == r["fingerprint"]) or edited != text


def test_winnowing_keeps_the_rightmost_least_of_each_window(spark):
    from pyspark.sql import functions as F
    text = "a b c d a b c d a b c d a b c d e f g h i j k l m n o p a b c d e f g"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(p.hash, p.position) for p in wn.winnow(df).first().fingerprint]
    ws = text.split()
    pairs = spark.createDataFrame([(i, w) for i, w in enumerate(ws)], "i int, w string")
    h = {r.i: r.h & 2**64 - 1 for r in pairs.select("i", F.xxhash64("w").alias("h")).collect()}

    def rot(x, n):
        return (x << n | x >> (64 - n)) & 2**64 - 1

    grams = [rot(h[i], 3) ^ rot(h[i + 1], 2) ^ rot(h[i + 2], 1) ^ h[i + 3] for i in range(len(ws) - 3)]
    grams = [g & 0x7FFFFFFF for g in grams]
    want = []
    for j in range(len(grams) - wn.W + 1):
        best = min(range(j, j + wn.W), key=lambda i: (grams[i], -i))
        if (grams[best], best) not in want:
            want.append((grams[best], best))
    assert got == want


def near_copies():
    """80 texts that differ from one text in a word each."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    return [(i + 10, " ".join(words[:i + 20] + [f"x{i}"] + words[i + 21:])) for i in range(80)]


def test_a_group_of_near_copies_is_dealt_over_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)
    held = []

    def watched(blocks, num, den, inner=nj._links_in_blocks):
        held.extend(blocks.groupBy("team", "block").agg(
            F.sum(F.length("grams") / 8).alias("n")).collect())
        return inner(blocks, num, den)

    monkeypatch.setattr(nj, "_links_in_blocks", watched)
    monkeypatch.setattr(nj, "BLOCK", 2000)
    monkeypatch.setattr(nj, "PIVOTS", 2, raising=False)
    found = nj.join_groups(docs).collect()
    assert {r.component_id for r in found} == {10} and len(found) == 80
    assert len(held) > 2 and max(r.n for r in held) < 3 * 2000


def test_signatures_are_combined_before_they_are_dealt(spark):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").coalesce(1)
    rows = nj.signature_rows(docs, 5, 80, 100)
    assert rows.groupBy("sig").count().agg(F.max("count")).first()[0] == 1
    edges = rows.filter("a IS NOT NULL")
    assert 79 <= edges.count() == edges.select("a", "short").distinct().count()


class Rows:
    """Stands for a frame: mapInArrow gives what the function yields for one batch."""

    dtypes, columns = [("rep", "bigint"), ("text", "string")], ["rep", "text"]

    def __init__(self, texts):
        self.batch = pa.RecordBatch.from_pydict({"rep": list(range(len(texts))), "text": texts})

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_texts_become_sets_one_by_one(monkeypatch):
    monkeypatch.setattr(nj, "KNOWN", 10, raising=False)
    read = []
    shingle = nj.Shingler(2)
    sets = shingle(read.append(i) or f"word{i} and word{i + 1} or more{i}" for i in range(40))
    first = next(iter(sets))
    assert read == [0] and len(first) == 4
    rest = list(sets)
    assert len(rest) == 39 and len(shingle.known) <= 10
    assert all(len(np.intersect1d(first, s)) == 0 for s in rest)


def test_sets_are_sent_in_slices_of_bounded_size(monkeypatch):
    texts = [" ".join(f"w{i}_{j}" for j in range(30)) for i in range(50)] + ["long " * 3000, "a b c"]
    whole = pa.Table.from_batches(nj.sets_of(Rows(texts), 3)).to_pydict()
    monkeypatch.setattr(nj, "HELD", 10_000, raising=False)
    parts = nj.sets_of(Rows(texts), 3)
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pydict() == whole
    assert all(p.num_rows == 1 or sum(map(len, p.column("grams").to_pylist())) <= 10_000 for p in parts)


def test_signatures_of_a_bounded_number_are_combined_at_once(monkeypatch):
    texts = [t for _, t in near_copies()]
    monkeypatch.setattr(nj, "COMBINED", 1000, raising=False)
    sizes = []
    combined = nj._combined
    monkeypatch.setattr(nj, "_combined", lambda sigs, shorts: sizes.append(len(sigs)) or combined(sigs, shorts))
    nj.signature_rows(Rows(texts), 5, 80, 100)
    most = max(len(nj.part_signatures(s, nj.Ladder(80, 100))) for s in nj.Shingler(5)(texts))
    assert len(sizes) > 1 and max(sizes) < 1000 + most


def test_an_index_takes_little_memory():
    rng = random.Random(8)
    contexts, size = [], 0
    while size < sd.BATCH:
        contexts.append(bytes(rng.choices(b"abcdefgh ", k=150)))
        size += 150
    contexts[-1] = contexts[0]
    tracemalloc.start()
    try:
        found = sd.repeated_windows(contexts, 100)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found[-1].all() and sum(int(f.sum()) for f in found) == 51
    assert peak < 100e6


def test_contexts_that_share_half_a_window_go_on():
    anchor = b"0123456789abcdef"
    left, right = b"l" * 42, b"r" * 42
    group = [(42, left + anchor + b"x" * 42), (50, b"y" * 8 + left + anchor + b"z" * 34),
             (42, b"m" * 42 + anchor + right), (0, anchor + right + b"s" * 42),
             (42, b"n" * 42 + anchor + b"t" * 42), (41, b"l" * 41 + anchor + b"u" * 43)]
    assert sd.sharing(group, 100, 16) == [True, True, True, True, False, False]
    assert sd.sharing(group + [(None, anchor * 9)], 100, 16) == [True] * 7


def test_no_shared_window_is_left_out():
    rng = random.Random(5)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = {base[rng.randrange(20):] + bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(4)}
        met = {}
        for text in texts:
            for a, f, s, own, at in zip(*[c.tolist() for c in sd.contexts_of(text, 20, 4)]):
                context = text[f: f + s + 19]
                assert context[at: at + 4] == text[f + at: f + at + 4]
                met.setdefault(a, {})[context] = None if own else at
        for group in met.values():
            shared = sd.sharing([(at, c) for c, at in group.items()], 20, 4)
            windows = [{c[i: i + 20] for i in range(len(c) - 19)} for c in group]
            for i, w in enumerate(windows):
                if any(w & v for j, v in enumerate(windows) if j != i):
                    assert shared[i]


def test_only_contexts_that_may_share_windows_are_indexed(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common = word(30)  # of many texts, but no passage of 100 bytes
    docs = spark.createDataFrame(
        [(i, word(150) + common + word(150)) for i in range(30)], "doc_id long, text string").coalesce(1)

    def refuse(strings, width):
        raise RuntimeError("indexed")

    monkeypatch.setattr(sd, "repeated_windows", refuse)
    found = sd.digest_repeats(docs).collect()
    assert len(found) == 30 and all(r.n_removed == 0 for r in found)
