"""Every query of the library against its DuckDB SQL."""

import duckdb
import pytest

from traceloom.plans import api
from traceloom.queries import ORACLES, QUERIES
from traceloom.sources import traffic

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    own = [d[0] for d in cur.description]
    assert sorted(own) == columns
    assert got == sorted(repr([r[own.index(c)] for c in columns]) for r in cur.fetchall())


def test_limits():
    assert [api.parse_limit(x, 100) for x in (None, "", "x", "-1", "0", "7", "99999")] == [100, 100, 100, 100, 100, 7, 10_000]


def test_free_sql_only_reads(spark):
    assert api.free_sql(spark, " select ? AS a", [3]).first()[0] == 3
    assert api.free_sql(spark, "WITH a AS (SELECT id FROM range(3)) SELECT count(*) AS n FROM a WHERE id IN (SELECT 1)").first()[0] == 1
    for bad in ("DELETE FROM x", "DROP TABLE x", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM (SELECT reflect('java.lang.Math', 'abs', 1))", "SELECT 1 WHERE EXISTS (SELECT * FROM parquet.`/root/testdata`)", "WITH a AS (SELECT * FROM json.`/etc/x`) SELECT * FROM a", "SELECT (SELECT max(try_reflect('a', 'b')) FROM range(3))"):
        with pytest.raises(PermissionError):
            api.free_sql(spark, bad)


@pytest.mark.parametrize(
    "bad",
    [
        "SELECT TRANSFORM(a) USING 'cat' AS b FROM VALUES ('x') t(a)", "SELECT * FROM (SELECT TRANSFORM(a) USING 'cat' AS b FROM VALUES ('x') t(a))", "FROM VALUES ('x') t(a) SELECT TRANSFORM(a) USING 'cat' AS b",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT * FROM text.`/etc/hostname`", "WITH a AS (SELECT 1) SELECT * FROM a JOIN csv.`/etc/passwd`",
        "SELECT own_udf(1)", "SELECT (SELECT own_udf(id) FROM range(2) LIMIT 1)", "SELECT input_file_name()", "SELECT * FROM sql_keywords()", "SELECT system.builtin.java_method('a', 'b')", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT * FROM STREAM t", "SHOW TABLES", "TABLE x",
        "SELECT sum(x) OVER (ORDER BY x) FROM (SELECT reflect('a', 'b') AS x)", "SELECT transform(array(1), x -> own_udf(x))", "SELECT * FROM a, LATERAL (SELECT java_method('a', 'b'))",
    ],
)
def test_free_sql_refuses_what_is_not_listed(spark, bad):
    spark.udf.register("own_udf", lambda x: x)
    with pytest.raises(PermissionError):
        api.free_sql(spark, bad)


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT a, count(*) AS n FROM VALUES ('x'), ('y'), ('x') t(a) GROUP BY a HAVING count(*) > 1", [("x", 2)]), ("WITH a AS (SELECT id FROM range(4)), b AS (SELECT max(id) AS m FROM a) SELECT id FROM a, b WHERE id = m", [(3,)]),
        ("SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM seen ORDER BY id LIMIT 1 OFFSET 1", [(1, 2)]), ("SELECT id FROM seen UNION SELECT id FROM seen EXCEPT SELECT 0 ORDER BY id", [(1,), (2,)]),
        ("SELECT e FROM seen LATERAL VIEW explode(array(id, 10)) t AS e WHERE id = 0 ORDER BY e", [(0,), (10,)]), ("SELECT * FROM (SELECT id % 2 AS k, id FROM seen) PIVOT (sum(id) FOR k IN (0, 1))", [(2, 1)]),
        ("SELECT transform(array(id), x -> x + 1)[0] AS n FROM seen WHERE id IN (SELECT max(id) FROM seen) AND EXISTS (SELECT 1 FROM seen)", [(3,)]), ("SELECT /*+ BROADCAST(seen) */ DISTINCT upper('a') AS a FROM seen TABLESAMPLE (100 PERCENT)", [("A",)]),
        ("SELECT a.id, b.x FROM seen a, LATERAL (SELECT a.id + 1 AS x) b WHERE a.id = 1", [(1, 2)]), ("SELECT array_sort(collect_list(id))[1] AS m, regexp_replace('ab', 'b', 'c') AS r FROM seen", [(1, "ac")]),
    ],
)
def test_free_sql_allows_what_reads(spark, sql, rows):
    spark.range(3).createOrReplaceTempView("seen")
    assert [tuple(r) for r in api.free_sql(spark, sql).collect()] == rows


def test_free_sql_reads_views_of_any_plan(spark):
    """What a registered view is made of is not the statement's."""
    spark.range(3).mapInArrow(lambda batches: batches, "id long").createOrReplaceTempView("made")
    spark.sql("CREATE OR REPLACE TEMP VIEW over AS SELECT id FROM made WHERE id > 0")
    assert api.free_sql(spark, "SELECT count(*) AS n FROM over WHERE id < ?", [2]).first()[0] == 1


def test_traffic_is_put_together_once(spark, sf):
    """Messages are folded in Python before; no plan over the traced traffic folds them again."""
    seen = traffic.traced(spark, sf)
    assert "MapInArrow" not in seen._jdf.queryExecution().executedPlan().toString()
    assert seen.where("source = 'sse_processor'").count() > 0
