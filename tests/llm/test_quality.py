import pytest
from pyspark.sql import functions as F

from pennywright.llm import quality_classifier as qc, quality_rules as qr
from tests.llm import brute


def test_counts_and_verdicts_match_brute_force(docs, corpus):
    got = sorted((tuple(r) for r in qr.measure(docs).collect()), key=repr)
    assert got == sorted(((i, *brute.quality(t)) for i, t in corpus), key=repr)


def test_kept_rows_are_those_judged_kept_in_any_order_of_rules(docs, corpus):
    want = sorted((i for i, t in corpus if brute.quality(t)[-1]), key=repr)
    for order in (None, list(qr.METHOD + qr.BASE)):
        kept = qr.keep_documents(docs, order=order)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_rules_are_ordered_by_rejection_per_work(docs):
    cheap = qr.Rule("cheap", ("n_words",), "n_words < 50", "1")
    dear = qr.Rule("dear", ("n_words",), "n_words < 50", "100 * n_chars")
    never = qr.Rule("never", ("n_words",), "n_words < 0", "1")
    assert [r.name for r in qr.ordered_rules(docs, [never, dear, cheap])] == ["cheap", "dear", "never"]


def test_empty_table(no_docs):
    assert qr.measure(no_docs).count() == 0
    assert qr.keep_documents(no_docs).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, ("clean words of a plain text number %d here. " % i) * 12 if i % 3 else "#### $$ %% || " * 40,
             int(i % 3 > 0)) for i in range(240)]
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 1), (5, None, 0)],
                                  "doc_id long, quality int, toxic int"))


def test_classifier_separates_held_out_rows(labelled):
    docs, labels = labelled
    rows = qc.score_documents(docs, labels).collect()
    assert len(rows) == 240 and any(r.held_out for r in rows)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_never_reads_held_out_labels(labelled):
    docs, labels = labelled
    wrong = labels.withColumn("quality", F.when(qc.fold(4) == 2, 1 - F.col("quality")).otherwise(
        F.col("quality")))
    a = {r.doc_id: r.score for r in qc.score_documents(docs, labels).collect()}
    b = {r.doc_id: r.score for r in qc.score_documents(docs, wrong).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_classifier_without_labels_and_on_odd_rows(docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = qc.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.5}
    assert qc.score_documents(no_docs, labels).count() == 0


def test_isotonic():
    got = qc.isotonic([0.1, 0.5, 0.3, 0.9], [1, 1, 1, 2])
    assert [round(float(x), 6) for x in got] == [0.1, 0.4, 0.4, 0.9]
