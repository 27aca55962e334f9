import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pennywright.llm import language_model as lm, mixing, packing
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def pieces_of(tokenizer, text, capacity):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    for piece, at in enumerate(range(0, len(ids), capacity)):
        part = ids[at: at + capacity]
        yield piece, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_holds_every_piece_once_without_gaps(docs, corpus, tokenizer, capacity):
    rows = packing.pack(docs, PATH, capacity).collect()
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == collections.Counter(
        (i, *p) for i, t in corpus for p in pieces_of(tokenizer, t, capacity))
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    least = math.ceil(sum(r.length for r in rows) / capacity)
    assert len(sequences) <= least + max(2, least // 10)


def test_packing_of_an_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0


def test_plan_beats_plain_best_fit_where_triples_fit_exactly():
    counts = {30: 60, 34: 60, 36: 60, 50: 40, 60: 20, 40: 20}
    slots = packing.plan_slots(counts, 100, 200)
    used = {s + (t - f) // p - 1 for _, f, t, s, p, _ in slots}
    plain = sum(n for _, n in packing.best_fit([], list(counts.items()), 100))
    assert 60 + 20 + 20 <= max(used) + 1 <= 105 < plain  # 100 is the optimum


def test_words_with_marks_and_separators_encode_as_in_the_text(tokenizer):
    texts = ["İ é é x́ ́a", "don't I'LL", "a\x1cb \x1d", "ΣΑΣ ς H̱ ẖ", "ab.\"c\" d!? e...f",
             "<|endoftext|> ok", " \n", "ﬁ ½.", "日本。語"]
    got = packing.WordEncoder(PATH)(texts)
    assert got == [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(
        t, add_special_tokens=False).ids) for t in texts]


def test_mixture_takes_whole_prefixes_within_budgets(docs, corpus):
    rows = mixing.mix(docs, (1, 2), 2).collect()
    total = sum(len(brute.words(t)) for _, t in corpus)
    assert 0 < sum(r.n_tokens for r in rows) <= total // 2
    leaves = collections.defaultdict(list)
    for r in mixing.narrow(docs).collect():
        for epoch in (1, 2):
            key = f"mix-1:{epoch}:{'' if r.doc_id is None else r.doc_id}"
            leaves[r.domain, r.lang, r.source, epoch].append(
                (hashlib.md5(key.encode()).hexdigest(), r.doc_id, r.n_tokens))
    taken = collections.Counter((r.domain, r.lang, r.source, r.epoch, r.doc_id) for r in rows)
    for leaf, found in leaves.items():
        flags = [taken[(*leaf, i)] > 0 for _, i, _ in sorted(found, key=lambda x: x[0])]
        assert flags == sorted(flags, reverse=True)  # a prefix of the seeded order
        if leaf[3] == 2 and any(flags):
            first = leaves[(*leaf[:3], 1)]
            assert all(taken[(*leaf[:3], 1, i)] for _, i, _ in first)


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "x", "s0", 10), ("a", "x", "s4", 1000), ("a", "y", "s0", 1000), ("b", "x", "s1", 1000)]
    df = spark.createDataFrame(
        [(i, d, la, s, n) for i, (d, la, s, n) in enumerate(rows)],
        "doc_id long, domain string, lang string, source string, n_tokens long")
    from pyspark.sql import functions as F
    one = {level: F.lit(1) for level in mixing.LEVELS}
    got = {(r.domain, r.lang, r.source): r.got for r in mixing.budgets(df, (800, 3010), 1, one).collect()}
    # a and b get 400 each, x and y of a 200 each; s0 of x has 10 only, its sibling takes 190
    assert got == {("a", "x", "s0"): 10, ("a", "x", "s4"): 190, ("a", "y", "s0"): 200, ("b", "x", "s1"): 400}


def test_mixture_of_nothing(docs, no_docs):
    assert mixing.mix(no_docs).count() == 0
    assert mixing.select_documents(no_docs).count() == 0
    assert mixing.mix(docs, (0, 1)).count() == 0
    whole = mixing.select_documents(docs, (1, 1))
    assert whole.columns == docs.columns and whole.count() == len(
        [r for r in mixing.narrow(docs).collect()]) - leaves_without_tokens(docs)


def leaves_without_tokens(docs):
    rows = mixing.narrow(docs).collect()
    sums = collections.Counter()
    for r in rows:
        sums[r.domain, r.lang, r.source] += r.n_tokens
    return sum(1 for r in rows if not sums[r.domain, r.lang, r.source])


@pytest.mark.parametrize("vocabulary", [lm.VOCABULARY, 20, 0])
def test_base_scores_match_brute_force(docs, corpus, vocabulary):
    tokens = [(i, brute.words(brute.lower(t)) + [None]) for i, t in corpus]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in corpus}
    counts = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held[i], len(ws), sum(counts[w] > 0 for w in ws), n,
                    round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
                   for i, ws in tokens), key=repr)
    rows = lm.score_documents(docs, vocabulary=vocabulary).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in rows), key=repr) == want
    assert all(r.score < 0 for r in rows)


def test_model_beats_base_on_held_out_text_with_order(spark):
    texts = [(i, " ".join(["red green", "blue black", "one two three"][(i + k) % 3] for k in range(60)))
             for i in range(200)]
    rows = lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)


def _plain_softmax(weights, rows, bias):
    logits = [sum(float(weights[r, k]) for r in rows) + float(b) for k, b in enumerate(bias)]
    top = max(logits)
    total = sum(math.exp(x - top) for x in logits)
    return [x - top - math.log(total) for x in logits]


@pytest.fixture(scope="module")
def model(docs):
    train = docs.select("doc_id", "text").filter(~lm.held_out(1, 5))
    sums = lm.count_all(train)
    return lm.fit(train, sums), {bytes(r.word): r.n for r in lm.token_counts(sums).collect()}


def test_scores_match_brute_force(docs, corpus, model, monkeypatch):
    made, counts = model
    monkeypatch.setattr(lm, "fit", lambda *_: made)
    w, square = made.width, made.width ** 2
    frequent = (w - w // 2) * w

    def plain(text):
        """One token after the other, from the definition of the features."""
        words = brute.words(brute.lower(text)) + [""]
        words = [x.encode() for x in words]
        places = [made.place_of(x) for x in words]
        out = 0.0
        for i, word in enumerate(words):
            own = places[i] // w
            one = places[i - 1] if i > 0 else square
            two = places[i - 2] if i > 1 else square
            before = [p for p in places[: max(0, i - 2)] if p < frequent]
            skip = before[-1] if before else square
            hashes = [lm.word_hash(words[i - k]) if i >= k else 7 for k in (1, 2)]
            pair = (hashes[0] * 0x9E3779B97F4A7C15 + hashes[1]) % 2 ** 64

            def spread(key):
                return ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9 % 2 ** 64 >> 24) % (4 * square)

            at = 3 * (square + 1)
            rows = [one, two + square + 1, skip + 2 * (square + 1), at + spread(pair)]
            by_class = _plain_softmax(made.weights, rows, made.class_bias)
            rows = [at + 4 * square + spread((own << 32) + one), at + 8 * square + spread((own << 32) + skip)]
            by_member = _plain_softmax(made.weights, rows, made.member_bias[own])
            out += by_class[own] + by_member[places[i] % w]
            out += math.log((counts.get(word, 0) + 0.5) / made.mass[places[i]])
        return out / math.log(10)

    want = {(i, len(brute.words(t))): plain(t) for i, t in corpus}
    for vocabulary in (lm.VOCABULARY, 20):
        for r in lm.score_documents(docs, vocabulary=vocabulary).collect():
            assert math.isclose(r.score, want[r.doc_id, r.n_tokens - 1], rel_tol=1e-3)


def test_probabilities_of_known_and_unknown_events_sum_to_one(model):
    made, counts = model
    w = made.width
    mass = np.zeros(w * w)
    for word, n in counts.items():
        mass[made.place_of(word)] += n + 0.5
    mass[(w - w // 2) * w:] += 0.5  # an unknown word of the member
    rows = np.array([[3, w * w + 5, 2 * w * w + 9, 3 * w * w + 70]])
    by_class = np.divide(*lm.softmax(made.weights, rows, made.class_bias))[0]
    total = 0
    for c in range(w):
        rows = np.array([[8 * w * w + c, 12 * w * w + c]])
        by_member = np.divide(*lm.softmax(made.weights, rows, made.member_bias[c]))[0]
        total += by_class[c] * (by_member * mass[c * w: c * w + w] / made.mass[c * w: c * w + w]).sum()
    assert abs(total - 1) < 1e-3


def test_endings_are_clustered_by_what_they_follow():
    profiles = np.zeros((lm.ENDINGS, 4), np.int64)
    profiles[1:40, 0], profiles[40:90, 2] = 500, 700
    found = lm.clustered(profiles, 2)
    assert len(set(found[1:40])) == 1 and len(set(found[40:90])) == 1 and found[1] != found[50]
    assert set(lm.clustered(np.zeros((lm.ENDINGS, 1), np.int64), 4)) <= {0, 1, 2, 3}


def test_counts_and_scores_do_not_depend_on_chunks(docs, model, monkeypatch):
    made, _ = model
    monkeypatch.setattr(lm, "fit", lambda *_: made)
    whole = sorted(map(repr, lm.score_documents(docs).select("doc_id", "n_known", F.round("score", 4)).collect()))
    monkeypatch.setattr(lm, "CHUNK", 50)
    monkeypatch.setattr(lm, "KEPT_COUNTS", 10)
    cut = sorted(map(repr, lm.score_documents(docs).select("doc_id", "n_known", F.round("score", 4)).collect()))
    assert cut == whole


def test_scores_of_an_empty_table(no_docs):
    assert lm.score_documents(no_docs).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    path = str(tmp_path)
    plain = docs.drop("__mx_hash")
    plain.write.parquet(path + "/documents.parquet")
    kept = plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path)
        assert kept.columns == plain.columns, name
    rows = [(r.doc_id, r.text) for r in plain.collect()]
    good = [(i, t) for i, t in rows if brute.quality(t)[-1]]
    named = [r for r in set(good) if r[0] is not None]
    first = brute.groups(named, 5, 80, 100)
    stay = {i for i in first if first[i][1] == i} | {i for i, _ in good if i is None}
    assert {r.doc_id for r in kept.collect()} <= stay
    out = corpus_pipeline.run(spark, path)
    got = {r.doc_id for r in out.collect()}
    assert got and got == {r.doc_id for r in kept.collect()}


def test_stages_hand_python_batches_of_bounded_size(spark):
    no_docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.packed):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, no_docs, "")
        texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("text "), 2000).alias("text"))
        sizes = texts.mapInArrow(_sizes, "n long").collect()
        assert max(r.n for r in sizes) < 2 * corpus_pipeline.BATCH_BYTES


def _sizes(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})


def test_every_token_trains_all_of_its_features():
    width = 8
    model = lm.Model(width, {lm.END: 0, b"a": 1, b"b": 2}, np.full(lm.ENDINGS, width - 1), np.ones(width * width),
                     np.zeros((lm.table_rows(width), width), np.float32))
    trainer = lm.Trainer(model, 1e-2)
    texts = ["a b a word other a b", "b word a"]
    trainer.texts(texts)
    words, ids, starts, _ = lm.flat([lm.tokens_of(t) for t in texts])
    hashes, places = lm.encoded(model, words)
    rows = np.hstack(lm.features_of(width, hashes[ids], places[ids], starts))
    assert (trainer.used == np.bincount(rows.ravel(), minlength=len(trainer.used))).all()
    assert trainer.weights[np.unique(rows)].any(axis=1).all()


def test_tokens_are_looked_up_once_each(monkeypatch):
    looked = []

    class Watched(dict):
        def __init__(self, make):
            self.make = make

        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

        def __missing__(self, word):
            self[word] = self.make()
            return dict.__getitem__(self, word)

    monkeypatch.setattr(lm, "defaultdict", Watched)
    distinct, ids, starts, sizes = lm.flat([[b"b", b"a", b"b"], [], [b"c", b"a"]])
    assert distinct == [b"b", b"a", b"", b"c"] and ids.tolist() == [0, 1, 0, 2, 2, 3, 1, 2]
    assert starts.tolist() == [True, False, False, False, True, True, False, False]
    assert sizes.tolist() == [4, 1, 3] and len(looked) == len(ids)
