import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pennywright.llm import personal_data as pd
from pennywright.llm.char_tagger import Tagger, allowed

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aZ0195.@+- ()%é\n𝄞", max_size=60))
def test_patterns_match_plain_expressions(text):
    assert pd.base_spans(text) == plain_base(text)


def test_patterns_on_built_cases():
    for text in ["a.b@c-d.e.f@g.h i@j", "4397110767823743 4397 1107 6782 3743 439711076782374 ", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4",
                 "+1 (578) 555-6437 4918187128635271", "+49 30 1234567, +1 2 3", "x@y", "@a.b", "a@b..c d@e.f.", "", None]:
        assert pd.base_spans(text or "") == plain_base(text)


def test_long_words_are_read_once():
    for c in ("a", "1", ".", "+1 ", "1.", "@", "a@", "a@b.", "1 "):
        pd.base_spans(c * (400_000 // len(c)))
    pd.windows_of("1" * 400_000)


def test_gradients_are_those_of_the_loss():
    tagger = Tagger(2, 4).start(3)
    tagger.weights = {n: w.astype(np.float64) for n, w in tagger.weights.items()}
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 100, (3, 6))
    tags = np.array([[0, 1, 2, 0, 3, 4], [2, 2, 0, 0, 0, 0], [0, 0, 3, 4, 4, 1]])
    _, grad = tagger.gradients(ids, tags)
    for name, w in tagger.weights.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 12)]:
            keep, h = w[at], 1e-4
            w[at] = keep + h
            up = tagger.gradients(ids, tags)[0]
            w[at] = keep - h
            down = tagger.gradients(ids, tags)[0]
            w[at] = keep
            assert abs((up - down) / (2 * h) - grad[name][at]) < 2e-4 + 1e-2 * abs(grad[name][at])


def test_decoding_is_the_best_path():
    tagger = Tagger(1, 3).start(5)
    ids = np.array([[40, 97, 20, 3]])
    tags, e = tagger.decode(ids)
    moves, first = tagger.moves()

    def score(path):
        return first[path[0]] + e[0, 0, path[0]] + sum(
            moves[a, b] + e[i + 1, 0, b] for i, (a, b) in enumerate(zip(path, path[1:])))

    import itertools
    best = max(itertools.product(range(3), repeat=4), key=score)
    assert tags[0].tolist() == list(best)
    assert allowed(3)[0, 2] < -1000 and allowed(3)[1, 2] == 0


def test_spans_of_overlapping_windows_become_one_set():
    pd_text = " " * 100 + "(578) 555-6437" + " " * 50 + "+4 555 666 7777" + " " * 100
    cut = [(3, 100, 106, 9.0, False, True), (3, 104, 114, 9.0, True, False)]  # both windows cut it
    whole = [(3, 164, 179, 9.0, False, False), (3, 164, 172, 9.0, False, True)]
    rival = [(3, 166, 179, 5.0, False, False)]
    assert pd.reconciled(cut + whole + rival, pd_text) == [(3, 100, 114), (3, 164, 179)]
    assert pd.reconciled([(3, 100, 114, 1.0, False, False)], pd_text) == []  # too low a score


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = "an der the on st re ti ion ha ne ver ch lich le que de la eu ér".split()

    def prose(words):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))

    texts = []
    for i in range(n):
        email = f"{rng.choice(syllables)}{rng.choice(syllables)}.{rng.randrange(100):02d}@mail{i % 7}.example.com"
        span = {0: email, 1: ".".join(str(rng.randrange(256)) for _ in range(4)), 2: "4397110767823743",
                3: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"}[i % 4]
        texts.append(prose(rng.randint(5, 60)) + " " + span + " " + prose(rng.randint(5, 60)))
    return texts


@pytest.fixture(scope="module")
def tagger(spark):
    texts = corpus(300, 1)
    return pd.train_in_task(spark, [(t, pd.base_spans(t)) for t in texts])


def test_planted_forms_are_found_and_decoys_left(tagger):
    rng = random.Random(7)
    texts, wanted = [], []
    for i, t in enumerate(corpus(400, 2)):
        kind, i0, j0 = pd.base_spans(t)[0]
        form = pd.variant(kind, t[i0:j0], rng)
        text = t[:i0] + form + t[j0:]
        if pd.base_spans(text) == []:
            texts.append(text)
            wanted.append((kind, i0, i0 + len(form)))
    found = pd.added_spans(texts, [[] for _ in texts], tagger)
    hit = sum(w in f for w, f in zip(wanted, found))
    assert len(wanted) > 200 and hit >= 0.8 * len(wanted)
    decoys = []
    for t in corpus(400, 3):
        _, i0, j0 = pd.base_spans(t)[0]
        decoys.append(t[:i0] + pd._decoy(rng) + t[j0:])
    wrong = pd.added_spans(decoys, [pd.base_spans(t) for t in decoys], tagger)
    assert sum(map(len, wrong)) <= 0.03 * len(decoys)


def test_long_texts_are_read_to_the_end(tagger):
    filler = corpus(1, 4)[0].split(" 4")[0].replace("@", " ")
    filler = re.sub("[0-9]", "", filler)
    text = " ".join([filler] * 900) + " call (578) 555-6437 now " + filler
    spans = pd.added_spans([text], [pd.base_spans(text)], tagger)[0]
    at = text.index("(578)")
    assert ("phone", at, at + 14) in spans and len(text) > 100_000


def test_rows_and_digests(spark, docs, no_docs, tagger):
    assert pd.digest(no_docs).count() == 0  # nothing to learn from: no tagger
    texts = [r.text for r in docs.collect()]
    got = pd.digest(docs, tagger).collect()
    want = []
    extra = [(1, "mail a@b.cd, +1 (578) 555-6437 and 10.0.0.1 or 4397110767823743"), (1, "a@b.cd"), (None, None)]
    odd = spark.createDataFrame([(i, t, "x", 3) for i, t in extra], "doc_id int, text string, spans string, n_email int")
    for rows, frame in ((got, texts), (pd.digest(odd, tagger).collect(), [t for _, t in extra])):
        want = sorted(hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in plain_base(t)).encode()).hexdigest() for t in frame)
        assert sorted(r.base_sha256 for r in rows) == want
    first = next(r for r in pd.digest(odd, tagger).collect() if r.n_phone)
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 1, 1)
    assert set(first.spans.split(",")) >= {f"{k}:{i}:{j}" for k, i, j in plain_base(extra[0][1])}
    found = pd.find(odd, tagger).collect()
    assert found[0].base[0].kind in pd.KINDS or found[0].base == []


def test_sample_takes_whole_words_and_both_sorts(spark):
    rows = [(i, t) for i, t in enumerate(corpus(80, 5))] + [(1000 + i, "only words here " * 30) for i in range(80)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pd.sample(docs, 30)
    assert 25 <= len(got) <= 30 and sum(bool(s) for _, s in got) >= 15
    assert got == pd.sample(docs.repartition(3), 30)
    assert all(s == sorted(plain_base(t), key=lambda x: x[1:]) for t, s in got)


class Marks:
    """A tagger that marks runs of some characters, as others of the window would have it."""

    def __init__(self, marked):
        self.marked = pd.character_ids(marked)

    def moves(self):
        return np.zeros((9, 9), np.float32), np.zeros(9, np.float32)

    def decode(self, ids):
        inside = np.isin(ids, self.marked)
        begins = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
        begins[:, 0] = False  # cut by the window's start
        kind = 3 if "+" == chr(int(self.marked[0]) + 31) else 0
        tags = np.where(begins, 2 * kind + 1, np.where(inside, 2 * kind + 2, 0)).astype(np.int8)
        e = np.zeros((ids.shape[1], len(ids), 9), np.float32)
        e[:, :, 1:] = 1.0
        return tags, e


def every_window(text):
    return list(range(0, len(text), pd.STRIDE))


def test_written_out_addresses_with_plain_dots_are_read(monkeypatch):
    for text in ("write to jan at mail.example now", "jan AT mail.example", "jan at  mail [.] example", "jan [At] mail.example",
                 "jan (at) mail.example", "jan at mail dOT example"):
        assert pd.windows_of("x " * 300 + text), text
    assert not pd.windows_of("look at the mail. Then " * 3 + "x " * 200)


@pytest.mark.parametrize("marked", ["+0123456789-() ", "abcdefghijklmnopqrstuvwxyz@. "])
def test_added_spans_are_those_of_reading_every_window(monkeypatch, marked):
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            parts.append(rng.choice([
                " " * rng.randrange(200), "( ) - " * rng.randrange(40), "WORD, " * rng.randrange(40),
                "(578) 555-6437", "jan at mail.example", "jan" * rng.randrange(60) + " at mail.example.com",
                "a@b.c", "!", "\n", "jan [at] mail [dot] example", "long" * rng.randrange(50)]))
        texts.append("".join(parts))
    tagger, none = Marks(marked), [[] for _ in texts]
    some = pd.added_spans(texts, none, tagger)
    monkeypatch.setattr(pd, "windows_of", every_window)
    assert some == pd.added_spans(texts, none, tagger)
    assert sum(map(len, some)) > 5
