"""Input that is not tidy: quotes, line breaks, other headers, fractions, blank files."""

import pytest

from pennywright.operators import free_sql
from pennywright.operators.pairing import pair_in_order
from pennywright.sources import csv_statements as csv, feeds


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_quotes_and_line_breaks_in_csv(spark, tmp_path):
    path = put(tmp_path / "in", a='Date,Description,Amount\n01/02/2024,"JOE ""THE"" DINER, NY",5.00\n'
                                  '01/03/2024,"TWO\nLINES",6.00\n01/04/2024,PLAIN,7.00\n')
    rows = {r.description for r in csv.normalised(csv.read_csv(spark, path)).collect()}
    assert rows == {'JOE "THE" DINER, NY', "TWO\nLINES", "PLAIN"}


def test_folder_of_files_with_different_headers(spark, tmp_path):
    path = put(tmp_path / "in", a="Date,Description,Amount\n01/02/2024,ONE,5.00\n",
               b="Amount,Date,Memo\n6.00,01/03/2024,TWO\n")
    rows = {(r.description, float(r.amount)) for r in csv.read_folder(spark, path).collect()}
    assert rows == {("ONE", 5.0), ("TWO", 6.0)}


def test_export_and_import_keep_texts(spark, tmp_path):
    texts = ['say "hi"', "two\nlines", "a,b", "back\\slash"]
    path = str(tmp_path / "out")
    csv.export_csv(spark.createDataFrame([(t,) for t in texts], "what string"), path)
    assert sorted(r.what for r in csv.import_csv(spark, path).collect()) == sorted(texts)


def test_fractional_holdings(spark, tmp_path):
    path = put(tmp_path / "in", a="Symbol,Name,Quantity,Average Cost\nBTC,Coin,0.00412345,60000\n"
                                  "VTI,Fund,1.123456,150.12345\n")
    rows = {r.ticker: float(r.equity) for r in feeds.read_holdings_csv(spark, path).collect()}
    assert rows == {"BTC": 247.41, "VTI": 168.66}


def test_turn_log_reads_every_record(spark, tmp_path):
    rows = spark.range(5).selectExpr("id AS turn_number", "'q' AS question").coalesce(1)
    path = str(tmp_path / "log")
    feeds.write_turn_log(rows, path)
    assert feeds.read_turn_log(spark, path).count() == 5


def test_pairs_with_null_key_parts(spark):
    schema = "id long, statement_id long, date date, description string, amount double"
    left = spark.createDataFrame([(1, 7, None, None, 1.0), (2, 7, None, None, 1.0)], schema)
    right = spark.createDataFrame([(10, 70, None, None, 1.0)], schema)
    known = spark.createDataFrame([(7, 70)], "left_id long, right_id long")
    got = sorted(map(tuple, pair_in_order(left, right, known).collect()))
    assert got == [(1, 10), (2, None)]


@pytest.mark.parametrize("sql", [
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t", "SELECT java_method('java.lang.Runtime', 'getRuntime')",
    "SELECT `reflect`('a', 'b') FROM t", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM other",
    "SELECT * FROM t, other", "SELECT * FROM t JOIN default.secret USING (id)", "DROP TABLE t",
    "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
    "SELECT (SELECT max(x) FROM csv.`/etc/passwd`) FROM t",
])
def test_free_sql_refuses(spark, sql):
    with pytest.raises(PermissionError):
        free_sql.query(spark, sql, {"t": spark.range(3)})


@pytest.mark.parametrize("sql,want", [
    ("SELECT count(*) AS n FROM t", 3), ("WITH a AS (SELECT id FROM t) SELECT count(*) AS n FROM a JOIN t USING (id)", 3),
    ("SELECT count(*) AS n FROM (SELECT id FROM t) x, t y WHERE x.id = y.id", 3),
    ("SELECT max(extract(year FROM date'2024-01-02')) AS n FROM t", 2024),
    ("SELECT count(*) AS n FROM t WHERE 'from other' = 'from other' AND id > :least", 1),
])
def test_free_sql_runs(spark, sql, want):
    rows = free_sql.query(spark, sql, {"t": spark.range(3)}, {"least": 1} if ":least" in sql else None)
    assert rows.first().n == want
    assert not spark.catalog.tableExists("t")


@pytest.mark.parametrize("sql", [
    "SELECT * FROM IDENTIFIER('secret')",
    "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "SELECT * FROM t JOIN IDENTIFIER('sec' || 'ret') s ON true",
    "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/nation.parquet`')",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT (SELECT max(id) FROM secret) FROM t",
    "SELECT * FROM t WHERE id IN (SELECT id FROM secret)",
    "WITH a AS (SELECT * FROM secret) SELECT * FROM a",
    "SELECT * FROM t, LATERAL (SELECT id AS x FROM secret)",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'lineSeparator') FROM t",
    "SELECT * FROM stored_table",
    "SELECT * FROM (SELECT * FROM t UNION ALL SELECT id FROM secret)",
    "WITH t2 AS (SELECT 1 AS id) INSERT INTO stored_table SELECT id FROM t2",
    "SELECT 1; SELECT 2", "TABLE t", "FROM t SELECT id", "EXECUTE IMMEDIATE 'SELECT 1'",
])
def test_free_sql_refuses_by_the_resolved_plan(spark, sql):
    spark.range(2).createOrReplaceTempView("secret")
    spark.sql("CREATE TABLE IF NOT EXISTS stored_table (id LONG) USING parquet")
    try:
        with pytest.raises(PermissionError):
            free_sql.query(spark, sql, {"t": spark.range(3)})
        assert spark.table("stored_table").count() == 0
    finally:
        spark.catalog.dropTempView("secret")
        spark.sql("DROP TABLE stored_table")


@pytest.mark.parametrize("sql, want", [
    ("SELECT count(*) FROM t WHERE id IN (SELECT id FROM t WHERE id > 0)", 2),
    ("SELECT sum(r.id) FROM range(5) r JOIN t USING (id)", 3),
    ("SELECT max(x) FROM (SELECT explode(sequence(1, id + 1)) AS x FROM t)", 3),
    ("SELECT count(*) FROM IDENTIFIER('t')", 3),
    ("SELECT sum(a) FROM VALUES (1), (2) AS v(a), t", 9),
    ("WITH from_t AS (SELECT id FROM t), u AS (SELECT id FROM from_t) SELECT count(*) FROM u, from_t", 9),
    ("SELECT (SELECT max(id) FROM t) + extract(YEAR FROM DATE '2024-01-01')", 2026),
    ("/* INSERT INTO x */ SELECT count(*) -- from secret\n FROM t;", 3),
    ("SELECT count(DISTINCT 'from secret') FROM t a LEFT JOIN t b ON a.id = b.id + 1", 1),
])
def test_free_sql_accepts_correct_selects(spark, sql, want):
    assert free_sql.query(spark, sql, {"t": spark.range(3)}).first()[0] == want


def test_free_sql_frames_may_read_anything(spark):
    stored = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    assert free_sql.query(spark, "SELECT count(*) FROM nations", {"nations": stored}).first()[0] == stored.count()
