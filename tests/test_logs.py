"""Compacted logs and running totals."""

import datetime
import os
from decimal import Decimal

import pytest

from pennywright.operators.keyed_table import KeyedTable
from pennywright.streaming import batches, feed

SCHEMA = "k long, v long"


def merge(rows):
    return batches.newest_rows(rows, "k", "batch_id")


def test_levels_cover_the_log(spark, tmp_path):
    path, fan = str(tmp_path / "log"), 3
    for n in range(11):
        batches.write_batch(spark.createDataFrame([(n % 4, n), (100 + n, n)], SCHEMA), path, n)
        batches.compact(spark, path, SCHEMA, merge, n, fan)
    folders = batches.cover(spark, path)
    assert folders == [(2, 0, 8), (0, 9, 9), (0, 10, 10)]
    rows = batches.current_rows(batches.read_log(spark, path, SCHEMA), "k", "batch_id")
    want = {n % 4: n for n in range(11)} | {100 + n: n for n in range(11)}
    assert {r.k: r.v for r in rows.collect()} == want
    # an unfinished merge is not read
    os.makedirs(f"{path}-merged/9-0-10")
    assert batches.cover(spark, path) == folders
    assert batches.read_log(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_no_batch_merges_that_may_run_again(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(2):
        batches.write_batch(spark.createDataFrame([(1, n)], SCHEMA), path, n)
    batches.compact(spark, path, SCHEMA, merge, 1, 2)
    assert batches.cover(spark, path) == [(0, 0, 0), (0, 1, 1)]


def transaction(i, month, amount, pending, category="food"):
    at = datetime.datetime(2024, month, 3, 12)
    return (i, at, at.date(), "Shop", Decimal(amount), category, pending)


@pytest.fixture
def stream(spark, tmp_path):
    base = str(tmp_path)
    held = KeyedTable(spark, f"{base}/held", "transaction_id", buckets=4)

    def run(rows, checkpoint="cp"):
        if rows:
            spark.createDataFrame(rows, feed.FEED).coalesce(1).write.mode("append").parquet(f"{base}/feed")
        source = spark.readStream.schema(feed.FEED).parquet(f"{base}/feed")
        feed.running_totals(source, held, f"{base}/totals", f"{base}/{checkpoint}", fan=2).awaitTermination()
        return {(r.month, r.category): (r.total_spent, r.transaction_count)
                for r in feed.month_totals(spark, f"{base}/totals").collect()}

    run.base, run.held = base, held
    return run


def test_late_posts_correct_the_totals(stream):
    assert stream([transaction(1, 1, "10.00", True), transaction(2, 1, "5.00", True), transaction(3, 1, "-4", False)]) == {
        ("2024-01", "food"): (15.0, 2)}
    # posted with another amount, in another month and category; one turns into a refund
    assert stream([transaction(1, 2, "12.50", False, "fuel"), transaction(2, 1, "-5.00", False)]) == {
        ("2024-02", "fuel"): (12.5, 1)}
    # a pending row that comes late changes nothing; a posted one that comes again replaces
    assert stream([transaction(1, 1, "10.00", True), transaction(4, 2, "1.00", False, None)]) == {
        ("2024-02", "fuel"): (12.5, 1), ("2024-02", None): (1.0, 1)}
    assert stream([transaction(1, 2, "13.00", False, "fuel")]) == {
        ("2024-02", "fuel"): (13.0, 1), ("2024-02", None): (1.0, 1)}


def test_a_batch_counts_once_however_often_it_runs(stream, monkeypatch):
    first = stream([transaction(1, 1, "10.00", True)])
    # died after the table committed, before the stream noted the batch
    for name in os.listdir(f"{stream.base}/cp/commits"):
        os.remove(f"{stream.base}/cp/commits/{name}")
    assert stream([]) == first
    # died after the changes were written, before the table committed
    real = KeyedTable._commit
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception):
            stream([transaction(1, 1, "11.00", False)])
    assert KeyedTable._commit is real
    assert stream([]) == {("2024-01", "food"): (11.0, 1)}
