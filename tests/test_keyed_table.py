import os
import random

import pytest
from pyspark.sql import functions as F

from pennywright.operators import tables
from pennywright.operators.keyed_table import KeyedTable

SCHEMA = "raw_id long, hash string, amount int, category string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(table, **at):
    return sorted(map(tuple, table.read(**at).collect()))


def data_bytes(path):
    """Bytes of data files by version, rows and indexes."""
    out = {}
    for folder, _, names in os.walk(path):
        if "version=" in folder and "/gone/" not in folder:
            v = int(folder.split("version=")[1].split("/")[0])
            out[v] = out.get(v, 0) + sum(os.path.getsize(f"{folder}/{n}") for n in names if n.endswith(".parquet"))
    return out


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "raw_id", unique=["hash"], buckets=32)
    t.create(frame(spark, [(i, f"h{i}", i, "old") for i in range(4000)]))
    return t


def test_an_upsert_writes_what_it_touches(spark, table):
    new = frame(spark, [(7, "h7", 70, "new"), (9001, "h9001", 1, "new"), (8, None, 80, None)])
    table.upsert(new, lambda old, n, key: tables.upsert_enrichment(old, n, key, ("category",)))
    rows = {r[0]: r for r in content(table)}
    assert rows[7] == (7, "h7", 7, "new") and rows[8] == (8, "h8", 8, None)
    assert rows[9001] == (9001, "h9001", 1, "new") and len(rows) == 4001
    size = data_bytes(table.path)
    assert size[2] < 0.4 * size[1]
    assert content(table, version=1) == [(i, f"h{i}", i, "old") for i in range(4000)]


def test_any_unique_column_replaces(spark, table):
    # h5 takes the row of key 5 away, though its own key is 5000
    table.insert_or_replace(spark.createDataFrame([(5000, "h5"), (6, None)], "raw_id long, hash string"), {"category": "none"})
    rows = {r[0]: r for r in content(table)}
    assert 5 not in rows and rows[5000] == (5000, "h5", None, "none") and rows[6] == (6, None, None, "none")
    # h6 was freed by the row before, h5 now belongs to 5000
    table.insert_or_replace(frame(spark, [(1, "h6", 1, "x"), (2, "h5", 2, "x")]))
    rows = {r[0]: r for r in content(table)}
    assert rows[6] == (6, None, None, "none") and 5000 not in rows and rows[2][1] == "h5"
    size = data_bytes(table.path)
    assert size[3] < 0.5 * size[1]


def test_deletes_write_keys_only_and_rows_may_come_back(spark, table):
    table.delete(spark.range(100, 300).withColumnRenamed("id", "raw_id"))
    assert len(content(table)) == 3800 and 2 not in data_bytes(table.path)
    table.upsert(frame(spark, [(150, "h150", 1, "again")]), tables.upsert_rows)
    assert (150, "h150", 1, "again") in content(table) and len(content(table)) == 3801
    table.delete(spark.createDataFrame([(150,), (None,), (10**9,)], "raw_id long"))
    assert len(content(table)) == 3800
    before = content(table)
    table.compact()
    assert content(table) == before and table.state()["gone"] == {}
    # a deleted row's value is free
    table.insert_or_replace(frame(spark, [(50_000, "h150", 5, "taken")]))
    assert len(content(table)) == 3801
    table.compact()
    # a key that comes back with another value does not answer for its old one
    table.delete(spark.createDataFrame([(20,)], "raw_id long"))
    table.insert_or_replace(frame(spark, [(20, "h20 anew", 1, "back")]))
    table.insert_or_replace(frame(spark, [(60_000, "h20", 1, "other")]))
    assert {(20, "h20 anew", 1, "back"), (60_000, "h20", 1, "other")} <= set(content(table))


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, table, monkeypatch):
    before = content(table)
    new = frame(spark, [(i, f"h{i}", -1, "new") for i in range(50)])

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        for change in (lambda: table.upsert(new, tables.upsert_rows), lambda: table.insert_or_replace(new),
                       lambda: table.delete(new)):
            with pytest.raises(OSError):
                change()
    assert content(table) == before and table.versions() == [1]
    table.upsert(new, tables.upsert_rows)
    assert sum(r[2] == -1 for r in content(table)) == 50 and table.versions() == [1, 2]


def test_two_writers_of_one_version(spark, table):
    state = table.state()
    table.delete(spark.range(3).withColumnRenamed("id", "raw_id"))
    with pytest.raises(RuntimeError):
        table._commit({**state, "version": 2})
    with pytest.raises(RuntimeError):
        table.create(frame(spark, []))


def test_schema_versions(spark, table):
    table.evolve(add={"note": "string"}, widen={"amount": "bigint"})
    assert dict(table.read().dtypes) == {"raw_id": "bigint", "hash": "string", "amount": "bigint",
                                         "category": "string", "note": "string"}
    table.upsert(spark.createDataFrame([(1, "h1", 2 ** 40, "c", "n")], table.read().schema), tables.upsert_rows)
    rows = {r.raw_id: r for r in table.read().collect()}
    assert rows[1].amount == 2 ** 40 and rows[2].amount == 2 and rows[2].note is None
    assert table.state()["schema_version"] == 2
    for bad in ({"widen": {"category": "int"}}, {"widen": {"raw_id": "double"}}, {"add": {"note": "int"}}):
        with pytest.raises(ValueError):
            table.evolve(**bad)


def test_empty_batches_and_tables(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "e"), "raw_id", unique=["hash"], buckets=4)
    t.create(frame(spark, []))
    assert content(t) == []
    t.upsert(frame(spark, []), tables.upsert_rows)
    t.insert_or_replace(frame(spark, []))
    t.compact()
    assert t.versions() == [1]
    t.insert_or_replace(frame(spark, [(1, "a", 1, "x")]))
    assert content(t) == [(1, "a", 1, "x")]


def test_random_changes_match_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    t = KeyedTable(spark, str(tmp_path / "r"), "raw_id", unique=["hash"], buckets=3)
    held = {i: (i, f"h{i}", i, "o") for i in range(20)}
    t.create(frame(spark, list(held.values())))
    for step in range(5):
        keys = rng.sample(range(30), 4)
        if step % 2 == 0:
            batch = [(k, f"h{h}", step, "r") for k, h in zip(keys, rng.sample(range(30), 4))]
            t.insert_or_replace(frame(spark, batch))
            for row in batch:
                held = {k: r for k, r in held.items() if k != row[0] and r[1] not in {b[1] for b in batch}}
            held.update({r[0]: r for r in batch})
        else:
            t.delete(spark.createDataFrame([(k,) for k in keys], "raw_id long"))
            held = {k: r for k, r in held.items() if k not in keys}
        assert content(t) == sorted(held.values())
