"""Run checked queries on Spark and DuckDB side by side.

    python -m checks.compare [sf_dir] [name-prefix ...]
"""

import datetime
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    from pennywright.session import recommended
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return recommended(spark)


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    sys.path.insert(0, os.getcwd())
    import duckdb
    from checks import load

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    queries, oracles = load()
    spark = session()
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in sorted(queries):
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - t0
            if name not in oracles:
                print(f"rows  {name:34s} {len(got):7d} {took:6.2f}s")
                continue
            cur = duck.execute(oracles[name])
            columns = [c[0] for c in cur.description]
            want = rows_of(columns, cur.fetchall())
            if sorted(df.columns) != sorted(columns):
                print("COLS ", name, sorted(df.columns), sorted(columns))
                bad += 1
            elif got != want:
                bad += 1
                diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
                print(f"DIFF  {name} spark={len(got)} duck={len(want)} {diff}")
            else:
                print(f"ok    {name:34s} {len(got):7d} {took:6.2f}s")
        except Exception as e:
            bad += 1
            print(f"FAIL  {name} {type(e).__name__}: {str(e)[:900]}")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
