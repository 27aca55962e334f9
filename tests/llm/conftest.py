import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __mx_hash string"


def make_docs():
    """A small corpus with copies, near copies, shared passages, odd and empty texts."""
    rng = random.Random(5)
    words = [a + b for a in ("al", "be", "co", "du", "él", "fö", "gu") for b in (
        "na", "ro", "sti", "t", "x", "mmer", "lo")]

    def prose(n):
        out = [rng.choice(words) for _ in range(n)]
        for i in range(9, n, 10):
            out[i] += rng.choice([".", ",\n", "\n"])
        return " ".join(out)

    passage = prose(40)
    texts = [prose(rng.randint(1, 160)) for _ in range(24)]
    texts += [texts[3], texts[3], texts[4]]  # copies
    near = texts[5].split(" ") if len(texts[5].split(" ")) > 60 else prose(120).split(" ")
    for i in range(5):
        copy = list(near)
        copy[7 * i + 3] = "changed"
        texts.append(" ".join(copy))
    texts += [prose(30) + " " + passage + " " + prose(20), passage + prose(50)]
    texts += ["", None, "   \n\t", "one", "Two words", "a a a a a a a " * 30, "x" * 400, "###$$$ " * 60,
              "The The The " * 60, prose(1500), "İ é ́ \x1c ß ﬁ 日本語。" * 3]
    rows = [(i * 3, t, ("en", "de", None)[i % 3], f"src{i % 5}" if i % 7 else None, len(t or ""), "h")
            for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    rows.append((None, "a text without an id " * 12, None, "web", 5, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) of the rows."""
    return [(r[0], r[1]) for r in make_docs()]
