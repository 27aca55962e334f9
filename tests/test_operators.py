"""Windows, joins, tables and validation against plain Python."""

import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pennywright.functions.fuzzy import best_alias, partial_ratio
from pennywright.operators import enrich, joins, pairing, tables, validate, windows

RELAXED = settings(max_examples=8, deadline=None,
                   suppress_health_check=[HealthCheck.function_scoped_fixture])


def slow_ratio(a, b):
    """The score by its definition: all windows, textbook LCS."""
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            last = 0
            for j, other in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if ch == other else max(row[j], row[j - 1])
        return row[-1]

    def one_way(s, t):
        m = len(s)
        cuts = [t[i:i + m] for i in range(len(t) - m + 1)]
        cuts += [t[:k] for k in range(1, m)] + [t[-k:] for k in range(1, m)]
        return max(200.0 * lcs(s, w) / (m + len(w)) for w in cuts if w)

    s, t = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    return max(one_way(s, t), one_way(t, s)) if len(a) == len(b) else one_way(s, t)


@settings(max_examples=150, deadline=None)
@given(st.text("ABC ", min_size=1, max_size=9), st.text("ABCD ", min_size=1, max_size=14))
def test_partial_ratio_by_definition(a, b):
    assert abs(partial_ratio(a, b) - slow_ratio(a, b)) < 1e-9


def test_partial_ratio_edges():
    assert partial_ratio("STARBUCKS", "XX STARBUCKS YY") == 100.0
    assert partial_ratio("", "A") == 0.0
    assert best_alias("STARBUKS STORE", ["NETFLIX", "STARBUCKS", "STARBUCK"], 75)[0] == 1
    assert best_alias("ZZZZZZ", ["NETFLIX"], 75) == (None, None)


SAMPLE = [
    ("AMZN*MKTP US*2K4F9 SEATTLE WA", "Amazon", "Shopping"),
    ("AMAZON PRIME MEMBERSHIP", "Amazon", "Shopping"),
    ("BLUEBOTTLE COFFEE #12", "Blue Bottle Coffee", "Dining"),
    ("UBER *TRIP HELP.UBER.COM CA", "Uber", "Transportation"),
    ("UBER EATS PENDING", "Uber Eats", "Dining"),
    ("WHOLE FOODS MARKET 00123", "Whole Foods", "Groceries"),
    ("SPOTIFY USA 855-666-1111 NY", "Spotify", "Uncategorized"),
    ("DELTA AIR 0062134500012 ATLANTA GA", "Delta Airlines", "Transportation"),
    ("ATM WITHDRAWAL CHASE BANK NYC", "Chase ATM", "Transfers & ATM"),
    ("STARBUKCS STORE", "Starbucks", "Dining"),
    ("CHEESECAKE FACTORY 0019 LOS ANGELES", "Cheesecake Factory Los", "Uncategorized"),
]


def raw_rows(spark, texts):
    rows = [(i, 1, "citi", "2024-01-15", t, "342.00" if "DELTA" in t else "5.00")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "id long, statement_id long, bank_name string, date string, description string, "
        "amount string").withColumns({
            "amount": F.col("amount").cast("decimal(18,2)"),
            "transaction_type": F.lit("DEBIT"), "balance": F.lit(None).cast("decimal(18,2)")})


def test_card_enrichment(spark):
    got = enrich.enrich_card(raw_rows(spark, [t for t, _, _ in SAMPLE])).orderBy("raw_id").collect()
    assert [(r.merchant_name, r.category) for r in got] == [(m, c) for _, m, c in SAMPLE]
    by_text = {r.description: r for r in got}
    assert by_text["STARBUKCS STORE"].enrichment_method == "fuzzy"
    assert 0.75 <= by_text["STARBUKCS STORE"].confidence_score < 1
    assert by_text["SPOTIFY USA 855-666-1111 NY"].confidence_score == 0.2
    assert by_text["SPOTIFY USA 855-666-1111 NY"].flags == ["needs_review"]
    assert by_text["DELTA AIR 0062134500012 ATLANTA GA"].flags == ["large_transaction"]


def test_hot_texts_give_the_same_rows(spark):
    texts = ["STARBUKCS STORE"] * 60 + ["NETFLUX"] * 3 + ["QQQ WWW"] * 40 + ["NETFLIX"] * 5
    rows = raw_rows(spark, texts)
    columns = ["raw_id", "merchant_name", "confidence_score", "enrichment_method"]
    plain = enrich.enrich_card(rows).select(*columns).orderBy("raw_id").collect()
    salted = enrich.enrich_card(rows, parts=7).select(*columns).orderBy("raw_id")
    assert len(plain) == len(texts) and plain == salted.collect()


def test_incremental_runs(spark):
    raw = raw_rows(spark, [t for t, _, _ in SAMPLE])
    done = enrich.enrich_card(raw)
    stats = enrich.run_stats(raw, done).first()
    assert (stats.total_raw, stats.processed, stats.skipped, stats.errors) == (11, 0, 11, 0)
    assert enrich.pending_input(raw, done, reprocess=True).count() == 11
    assert enrich.pending_input(raw, done, threshold=0.5).count() == 2


def test_one_run_enriches_what_is_pending(spark):
    from pyspark.sql import functions as F

    from pennywright.plans import enrichment
    raw = raw_rows(spark, [t for t, _, _ in SAMPLE])
    empty = enrich.enrich_card(raw).limit(0)
    first = enrichment.card(raw.filter("id % 2 = 0"), empty)
    second = enrichment.card(raw, first.table)
    stats = second.stats.first()
    assert (stats.processed, stats.skipped) == (raw.filter("id % 2 <> 0").count(),
                                                raw.filter("id % 2 = 0").count())
    want = enrich.enrich_card(raw).orderBy("raw_id").select("raw_id", "merchant_name")
    assert second.table.orderBy("raw_id").select("raw_id", "merchant_name").collect() == want.collect()
    lost = enrichment.card(raw.withColumn("id", F.when(F.col("id") > 1, F.col("id"))), empty)
    assert lost.stats.first().errors == raw.filter("id <= 1").count()


keyed_rows = st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([None, 1, 2, 3])),
                      min_size=1, max_size=40)


@RELAXED
@given(rows=keyed_rows, width=st.integers(1, 9), before=st.booleans())
def test_carry_forward_by_brute_force(spark, rows, width, before):
    data = [(i, k, m) for i, (k, m) in enumerate(rows)]
    df = spark.createDataFrame(data, "n long, k string, m int")
    got = {r.n: r.last for r in windows.carry_forward(
        df, ["k"], "n", {"last": F.col("m")}, width, before).collect()}
    last, want = {}, {}
    for n, k, m in data:
        if before:
            want[n] = last.get(k)
        if m is not None:
            last[k] = m
        if not before:
            want[n] = last.get(k)
    assert got == want


@RELAXED
@given(rows=keyed_rows, width=st.integers(1, 9))
def test_number_within_by_brute_force(spark, rows, width):
    data = [(i, k) for i, (k, _) in enumerate(rows)]
    df = spark.createDataFrame(data, "n long, k string")
    got = {r.n: r.ordinal for r in windows.number_within(df, ["k"], "n", width=width).collect()}
    seen, want = {}, {}
    for n, k in data:
        want[n] = seen[k] = seen.get(k, 0) + 1
    assert got == want


def test_pairs_of_repeated_keys(spark):
    schema = "id long, statement_id long, date string, description string, amount double"
    left = spark.createDataFrame(
        [(5, 1, "d", "x", 2.0), (3, 1, "d", "x", 2.0), (9, 1, "d", "x", 2.0), (4, 2, "d", "x", 2.0)],
        schema)
    right = spark.createDataFrame([(70, 11, "d", "x", 2.00001), (60, 11, "d", "x", 2.0)], schema)
    ids = spark.createDataFrame([(1, 11), (2, None)], "left_id long, right_id long")
    got = {r.left_id: r.right_id for r in pairing.pair_in_order(left, right, ids).collect()}
    assert got == {3: 60, 5: 70, 9: None}


def test_dense_ids_have_no_gaps(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    rows = windows.dense_ids(df, "file_hash", 40, prefix=2).orderBy("file_hash").collect()
    assert [r.id for r in rows] == list(range(41, 541))


def test_dense_ids_of_a_known_few_rows_are_the_same(spark):
    df = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    few = {(r.file_hash, r.id) for r in windows.dense_ids(df, "file_hash", 40, most=50).collect()}
    assert few == {(r.file_hash, r.id) for r in windows.dense_ids(df, "file_hash", 40).collect()}


def test_latest_rows_both_ways(spark):
    random.seed(1)
    rows = [(random.choice("ab"), random.randint(1, 5), i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, d int, i int")
    one = {r.i for r in windows.latest_rows(df, ["k"], "d").collect()}
    two = {r.i for r in windows.latest_rows_by_rank(df, ["k"], "d").collect()}
    top = {k: max(d for kk, d, _ in rows if kk == k) for k in "ab"}
    assert one == two == {i for k, d, i in rows if d == top[k]}


def enriched_frame(spark, rows):
    return spark.createDataFrame(
        rows, "raw_id long, description string, category string, confidence_score double")


def test_upserts(spark):
    old = enriched_frame(spark, [(1, "a", "X", 0.1), (2, "b", "Y", 0.2)])
    new = enriched_frame(spark, [(2, "B", None, 0.9), (3, "c", "Z", 0.3)])
    part = {r.raw_id: tuple(r) for r in tables.upsert_enrichment(old, new).collect()}
    assert part == {1: (1, "a", "X", 0.1), 2: (2, "b", None, 0.9), 3: (3, "c", "Z", 0.3)}
    whole = tables.upsert_rows(old, new)
    assert {r.raw_id: r.description for r in whole.collect()} == {1: "a", 2: "B", 3: "c"}
    again = tables.upsert_rows(whole, new)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(
        map(tuple, whole.collect()), key=str)
    reset = tables.insert_or_replace(old, new.select("raw_id", "description"), ["raw_id"],
                                     {"category": "Uncategorized"})
    assert {r.raw_id: r.category for r in reset.collect()} == {
        1: "X", 2: "Uncategorized", 3: "Uncategorized"}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_snapshot(spark, path) is None
    first = tables.write_snapshot(enriched_frame(spark, [(1, "a", "X", 0.1)]), path)
    more = tables.upsert_rows(first, enriched_frame(spark, [(1, "b", "X", 0.1)]))
    tables.write_snapshot(more, path)
    assert [r.description for r in tables.read_snapshot(spark, path).collect()] == ["b"]


def test_new_statements_and_outcomes(spark):
    registry = spark.createDataFrame([(7, "h1")], "id long, file_hash string")
    files = spark.createDataFrame(
        [("h1", "a"), ("h2", "c"), ("h2", "b"), ("h3", "d")],
        "file_hash string, original_path string")
    new = {r.file_hash: (r.id, r.original_path)
           for r in tables.new_statements(registry, files).collect()}
    assert new == {"h2": (8, "b"), "h3": (9, "d")}
    out = {r.original_path: r.outcome for r in tables.file_outcomes(registry, files).collect()}
    assert out == {"a": "imported before", "b": "new", "c": "duplicate", "d": "new"}


def test_rules(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01", "x", 1.0, "DEBIT"), (2, None, "x", -1.0, "OTHER")],
        "id int, date string, description string, amount double, transaction_type string")
    bad = validate.invalid_rows(rows).collect()
    assert [(r.id, r.problems) for r in bad] == [
        (2, ["date is missing", "transaction_type is unknown"])]
    assert validate.repeated_keys(rows, "description").first().n == 2
    assert [r.id for r in validate.amount_problems(rows).collect()] == [2]
    parents = spark.createDataFrame([(1,)], "id int")
    assert [r.id for r in joins.orphans(rows, parents, "id", "id").collect()] == [2]
