"""Keyed tables whose upserts and deletes cost what the batch touches, not what the table holds.

Rows lie in folders by the hash of their key, rows/version=V/bucket=B.  An upsert reads and rewrites
the buckets that its keys fall in, as a new version of those buckets; a delete writes only the
deleted keys (gone/version=V/bucket=B), which are left out on reading and folded in when their bucket is
next rewritten or compacted.  Further unique columns have their own folder of (value, key) by the
hash of the value, so that a conflict is found without reading the table.

One small file per version, commits/V.json, names the version of every bucket.  It appears by a
rename as the last step, so a job that dies before leaves the table as it was and may simply run
again.  One writer at a time: a version that is there already is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

WIDER = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "int"),
         ("tinyint", "bigint"), ("float", "double"), ("int", "double")}
ROWS = "rows"


class KeyedTable:
    """A table at `path` with one row per `key`; `unique` columns are unique as well, nulls apart.

    Choose `buckets` so that a bucket is about as large as a file should be.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, unique=(), buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.unique, self.buckets = list(unique), buckets

    # --- commits

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/commits")
                      if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict:
        """What the commit file of a version (the newest) says."""
        found = self.versions()
        if not found:
            return {"version": 0, "buckets": self.buckets, "parts": {}, "gone": {}}
        name = f"{self.path}/commits/{found[-1] if version is None else version}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def _commit(self, state: dict) -> None:
        fs, final = self._fs(f"{self.path}/commits/{state['version']}.json")
        _, draft = self._fs(f"{self.path}/commits/.{state['version']}.draft")
        if fs.exists(final):
            raise RuntimeError(f"version {state['version']} has been written by another job")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"version {state['version']} could not be committed")

    # --- files

    def _bucketed(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int"))

    def _touched(self, df: DataFrame, column: str) -> list[int]:
        """Buckets of the values: at most `buckets` numbers."""
        return sorted(r.bucket for r in self._bucketed(df.select(column), column).select(
            "bucket").distinct().collect())

    def _write(self, df: DataFrame, part: str, column: str, version: int, files: int) -> list[int]:
        """Write rows by bucket; the buckets that got some."""
        target = f"{self.path}/{part}/version={version}"
        self._bucketed(df, column).repartition(max(files, 1), "bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(target)
        return [int(n.split("=")[1]) for n in self._names(target) if n.startswith("bucket=")]

    def _schema(self, state: dict, part: str) -> StructType:
        rows = StructType.fromJson(state["schema"])
        if part == ROWS:
            return rows
        if part == "gone":
            return StructType([rows[self.key]])
        return StructType([rows[part.removeprefix("by_")], rows[self.key]])

    def _files(self, state: dict, part: str, places: list[tuple[int, int]]) -> DataFrame:
        """The rows of (bucket, version) places of a part, with column `version`."""
        schema = self._schema(state, part)
        if not places:
            return self.spark.createDataFrame([], schema).withColumn("version", F.lit(0))
        read = StructType([*schema.fields, *_parse_datatype_string("bucket int, version int").fields])
        return self.spark.read.schema(read).option("basePath", f"{self.path}/{part}").parquet(
            *[f"{self.path}/{part}/version={v}/bucket={b}" for b, v in places]).drop("bucket")

    def _read(self, state: dict, part: str, buckets: list[int] | None = None) -> DataFrame:
        live = {int(b): v for b, v in state["parts"].get(part, {}).items()
                if buckets is None or int(b) in buckets}
        rows = self._files(state, part, sorted(live.items()))
        dead = [(b, int(v)) for v, places in state["gone"].items() for b in places if b in live]
        if part == ROWS and dead:
            # a key that came back after its deletion stands in a later version than the deletion
            gone = self._files(state, "gone", dead).groupBy(F.col(self.key).alias("_key")).agg(
                F.max("version").alias("_gone"))
            rows = rows.join(gone, (rows[self.key] == F.col("_key")) & (rows["version"] < F.col("_gone")),
                             "left_anti")
        return rows.drop("version")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its newest (or a given) version."""
        return self._read(self.state(version), ROWS)

    # --- changes

    def _next(self, state: dict, written: dict[str, tuple[list[int], list[int]]]) -> dict:
        """The state after buckets were rewritten: part -> (touched, those that have rows now)."""
        version = state["version"] + 1
        parts = {p: dict(m) for p, m in state["parts"].items()}
        for part, (touched, full) in written.items():
            held = parts.setdefault(part, {})
            for b in touched:
                held.pop(str(b), None)
            held.update({str(b): version for b in full})
        folded = set(written.get(ROWS, ((), ()))[0])
        gone = {v: [b for b in places if b not in folded] for v, places in state["gone"].items()}
        return {**state, "version": version, "parts": parts, "gone": {v: p for v, p in gone.items() if p}}

    def create(self, rows: DataFrame) -> None:
        """Version 1 of an empty path: all rows, each key once."""
        state = self.state()
        if state["version"]:
            raise RuntimeError(f"{self.path} holds a table")
        state["schema"] = rows.schema.jsonValue()
        everything = list(range(self.buckets))
        written = {ROWS: (everything, self._write(rows, ROWS, self.key, 1, self.buckets))}
        for u in self.unique:
            pairs = rows.select(u, self.key).filter(F.col(u).isNotNull())
            written[f"by_{u}"] = (everything, self._write(pairs, f"by_{u}", u, 1, self.buckets))
        self._commit(self._next(state, written))

    def _swap(self, state: dict, touched: list[int], result: DataFrame, out: DataFrame,
              into: DataFrame) -> None:
        """Rewrite `touched` buckets as `result`, in which the rows `out` gave way to `into`."""
        version = state["version"] + 1
        names = [f["name"] for f in state["schema"]["fields"]]
        written = {ROWS: (touched, self._write(result.select(names), ROWS, self.key, version, len(touched)))}
        for u in self.unique:
            part = f"by_{u}"
            before, after = (x.select(u, self.key).filter(F.col(u).isNotNull()) for x in (out, into))
            places = self._touched(before.select(u).unionByName(after.select(u)), u)
            kept = self._read(state, part, places).join(before.select(self.key), self.key, "left_anti")
            pairs = kept.select(u, self.key).unionByName(after)
            written[part] = (places, self._write(pairs, part, u, version, len(places)))
        self._commit(self._next(state, written))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        rows = self._read(self.state(), ROWS, self._touched(keys, self.key))
        return rows.join(keys.select(self.key), self.key, "left_semi")

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame, str], DataFrame],
               note: dict | None = None) -> None:
        """Merge rows with `merge(old rows of their buckets, new rows, key)`.

        A `note`, such as the batch the rows come from, is committed with them (see `state`).
        """
        state = self.state()
        touched = self._touched(new, self.key)
        if note is not None:
            state["note"] = note
        if not touched:
            return
        old = self._read(state, ROWS, touched)
        result = merge(old, new, self.key)
        keys = new.select(self.key)
        self._swap(state, touched, result, old.join(keys, self.key, "left_semi"),
                   result.join(keys, self.key, "left_semi"))

    def insert_or_replace(self, new: DataFrame, defaults: dict | None = None) -> None:
        """New rows take the place of all rows that they meet on the key or a unique column.

        Columns that the new rows do not name get their default, or null.
        """
        state = self.state()
        schema = StructType.fromJson(state["schema"])
        new = new.select(*[
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns
            else F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        keys = [new.select(self.key)]
        for u in self.unique:
            values = new.select(u).filter(F.col(u).isNotNull())
            keys.append(self._read(state, f"by_{u}", self._touched(values, u)).join(
                values, u, "left_semi").select(self.key))
        dead = reduce(DataFrame.unionByName, keys).distinct()
        touched = self._touched(dead, self.key)
        if not touched:
            return
        # pairs of deleted rows may name a key that has come back with another value, so the rows
        # themselves decide
        old = self._read(state, ROWS, touched)
        kept = old
        for column in (self.key, *self.unique):
            kept = kept.join(new.select(column).filter(F.col(column).isNotNull()), column, "left_anti")
        out = old.join(kept.select(self.key), self.key, "left_anti")
        self._swap(state, touched, kept.select(*old.columns).unionByName(new), out, new)

    def delete(self, keys: DataFrame) -> None:
        """Leave rows out by their keys; no row is read or written."""
        state = self.state()
        gone = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        version = state["version"] + 1
        places = self._write(gone, "gone", self.key, version, 1)
        live = {int(b) for b in state["parts"].get(ROWS, {})}
        # (value, key) pairs of deleted rows stay until compaction; they only name rows that are gone
        self._commit({**state, "version": version,
                      "gone": {**state["gone"], str(version): [b for b in places if b in live]}})

    def compact(self) -> None:
        """Rewrite the buckets with deleted rows without them."""
        state = self.state()
        touched = sorted({b for places in state["gone"].values() for b in places})
        if not touched:
            return
        rows = self._read(state, ROWS, touched)
        raw = self._files(state, ROWS, [(b, state["parts"][ROWS][str(b)]) for b in touched]).drop("version")
        out = raw.join(rows.select(self.key), self.key, "left_anti")
        self._swap(state, touched, rows, out, rows.limit(0))

    def evolve(self, add: dict[str, str] | None = None, widen: dict[str, str] | None = None) -> None:
        """New columns (null in rows so far) and wider types, recorded as a new schema version.

        Only the commit file changes: Parquet files keep their types and are widened on reading.
        """
        state = self.state()
        fields = []
        for f in StructType.fromJson(state["schema"]):
            if f.name in (widen or {}):
                wider = _parse_datatype_string(widen[f.name])
                pair = (f.dataType.simpleString(), wider.simpleString())
                if f.name == self.key or f.name in self.unique or pair not in WIDER:
                    raise ValueError(f"{f.name} cannot change from {pair[0]} to {pair[1]}")
                f = StructField(f.name, wider, f.nullable)
            fields.append(f)
        known = {f.name for f in fields}
        for name, kind in (add or {}).items():
            if name in known:
                raise ValueError(f"{name} is there already")
            fields.append(StructField(name, _parse_datatype_string(kind)))
        self._commit({**state, "version": state["version"] + 1, "schema": StructType(fields).jsonValue(),
                      "schema_version": state.get("schema_version", 1) + 1})
