"""The alias index against plain scoring of every alias."""

import random

import pytest
from pyspark.sql import functions as F

from pennywright.functions.fuzzy import AliasIndex, best_alias, least_shared, partial_ratio, with_best_alias
from pennywright.operators import enrich

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ *&"


def near_misses(aliases, n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.choice(aliases)
        p, x = rng.randrange(len(a)), rng.choice(LETTERS)
        t = rng.choice([a, a[:p] + a[p + 1:], a[:p] + x + a[p:], a[:p] + x + a[p + 1:], a[::-1], a[p:],
                        "".join(rng.choice(LETTERS) for _ in range(rng.randrange(25)))])
        out.append(rng.choice(["", "SQ ", "POS "]) + t + rng.choice(["", " STORE", " AG"]))
    return out


@pytest.mark.parametrize("threshold", [50.0, 75.0, 90.0])
def test_index_loses_no_match(spark, threshold):
    aliases = [a for a, _ in enrich.fuzzy_list()] + ["ÄÖÜ BÄCKEREI", "AB", "AAAAAAAA"]
    texts = near_misses(aliases, 700, 3) + ["", "A", "é", "日本語 日本語", "AAAAAAA", "ÄÖÜ BACKEREI", None, "X" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.m.position, r.m.score) for r in with_best_alias(df, "t", "m", aliases, threshold).collect()}
    want = {i: best_alias(t, aliases, threshold) if t else (None, None) for i, t in enumerate(texts)}
    assert got == want
    assert sum(p is not None for p, _ in want.values()) > 200


def test_index_leaves_few_aliases_to_score(spark):
    aliases = [a for a, _ in enrich.fuzzy_list()]
    texts = near_misses(aliases, 300, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sizes = df.select(F.size(AliasIndex(aliases).candidates(F.col("t"))).alias("n")).collect()
    assert sum(r.n for r in sizes) < 0.5 * len(texts) * len(aliases)


def test_no_aliases(spark):
    df = spark.createDataFrame([(1, "ABC"), (2, None)], "i int, t string")
    assert [r.m.position for r in with_best_alias(df, "t", "m", []).collect()] == [None, None]


def test_least_shared_holds_for_pairs_that_match():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("ABCD") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("ABCD") for _ in range(rng.randint(1, 16)))
        short, long = sorted((a, b), key=len)
        if partial_ratio(a, b) >= 75 and len(a) != len(b):
            shared = sum(short[i: i + 2] in long for i in range(len(short) - 1))
            assert shared >= least_shared(len(short), 75.0)


def test_fallback_keeps_its_own_score(spark):
    rows = spark.createDataFrame([(1, "QQXZ KVJW PPLM")], "id long, description string")
    got = enrich.resolve_merchants(rows).first()
    assert (got.method, got.merchant_score) == ("fallback", 0.3)
