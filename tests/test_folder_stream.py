"""Folder import: state across restarts, and batches that cost what they bring."""

import os

from pennywright.operators import windows
from pennywright.streaming import folder
from pennywright.streaming.batches import read_batches


def put(path, files):
    os.makedirs(path, exist_ok=True)
    for name, content in files.items():
        with open(f"{path}/{name}", "w") as f:
            f.write(content)


def registry(spark, base):
    return {(r.id, r.filename) for r in read_batches(spark, f"{base}/registry", folder.REGISTRY).collect()}


def run(spark, base, per_batch=1000):
    query = folder.import_folder(spark, f"{base}/in", f"{base}/registry", f"{base}/cp", per_batch)
    query.awaitTermination()
    return query


def test_contents_are_imported_once_over_restarts(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", {"b.txt": "one", "a.txt": "one", "c.txt": "two"})
    run(spark, base)
    first = registry(spark, base)
    assert {n for _, n in first} == {"a.txt", "c.txt"} and {i for i, _ in first} == {1, 2}
    put(f"{base}/in", {"d.txt": "two", "e.txt": "three", "f.txt": " "})
    run(spark, base)  # a new query: the state comes from the checkpoint
    now = registry(spark, base)
    assert first < now and {n for _, n in now - first} == {"e.txt", "f.txt"}
    assert {i for i, _ in now} == {1, 2, 3, 4}
    run(spark, base)  # nothing new
    assert registry(spark, base) == now


def test_no_batch_reads_the_registry(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    put(f"{base}/in", {f"{i:02d}.txt": f"text {i % 9}" for i in range(12)})
    asked = []
    real = folder.read_batches
    monkeypatch.setattr(folder, "read_batches", lambda *a, **k: asked.append(a[-1]) or real(*a, **k))
    query = run(spark, base, per_batch=3)
    assert asked == [0]  # only before the first batch
    assert {i for i, _ in registry(spark, base)} == set(range(1, 10))
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) >= 4 and all(
        any(k.startswith("rocksdb") for k in p["stateOperators"][0]["customMetrics"]) for p in progress)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != folder.ROCKSDB


def test_a_batch_that_runs_again_replaces_its_own_rows(spark, tmp_path):
    """A batch that died after its rows were written, before the stream noted it as done."""
    base = str(tmp_path)
    put(f"{base}/in", {"a.txt": "one", "b.txt": "two"})
    run(spark, base)
    before = registry(spark, base)
    for name in os.listdir(f"{base}/cp/commits"):
        os.remove(f"{base}/cp/commits/{name}")
    run(spark, base)
    assert registry(spark, base) == before
    put(f"{base}/in", {"c.txt": "three"})
    run(spark, base)
    assert {i for i, _ in registry(spark, base)} == {1, 2, 3}


def test_a_batch_asks_its_state_once_in_few_partitions(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", {f"{i:02d}.txt": f"text {i}" for i in range(6)})
    query = run(spark, base, per_batch=3)
    states = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in states] == [3, 3]
    assert {s["numShufflePartitions"] for s in states} == {12}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert {i for i, _ in registry(spark, base)} == set(range(1, 7))


def test_a_batch_is_one_job_and_leaves_the_settings_alone(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", {"a.txt": "one"})
    run(spark, base)
    put(f"{base}/in", {f"{i}.txt": f"text {i % 5}" for i in range(8)})
    before = {k: spark.conf.get(k, None) for k in {**folder.SETTINGS, **folder.LOCAL}}
    query = run(spark, base, per_batch=2)
    assert before == {k: spark.conf.get(k, None) for k in before}
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))
    assert len(batches) == 4 and len(jobs) == 4
    assert {i for i, _ in registry(spark, base)} == set(range(1, 7))


def test_ids_go_on_from_notes_that_are_tables(spark, tmp_path):
    """As left by checkpoints of before; the batch that runs again replaces its note."""
    base = str(tmp_path)
    put(f"{base}/in", {"a.txt": "one", "b.txt": "two"})
    run(spark, base)
    os.remove(f"{base}/cp-ids/batch_id=0")
    spark.createDataFrame([(40,)], "last long").write.parquet(f"{base}/cp-ids/batch_id=0")
    put(f"{base}/in", {"c.txt": "three"})
    run(spark, base)
    assert {i for i, _ in registry(spark, base)} == {1, 2, 41}
    os.remove(f"{base}/cp/commits/1")
    os.remove(f"{base}/cp-ids/batch_id=1")
    spark.createDataFrame([(7,)], "last long").write.parquet(f"{base}/cp-ids/batch_id=1")
    run(spark, base)
    put(f"{base}/in", {"d.txt": "four"})
    run(spark, base)
    assert {i for i, _ in registry(spark, base)} == {1, 2, 41, 42}


def test_large_batches_are_numbered_in_blocks(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    put(f"{base}/in", {f"{i:02d}.txt": f"text {i % 9}" for i in range(12)})
    monkeypatch.setattr(folder, "BLOCK", 2)
    monkeypatch.setattr(windows, "BLOCK", 2)
    run(spark, base, per_batch=6)
    assert sorted(i for i, _ in registry(spark, base)) == list(range(1, 10))
    put(f"{base}/in", {"new.txt": "new"})
    run(spark, base, per_batch=6)
    assert {i for i, n in registry(spark, base) if n == "new.txt"} == {10}
