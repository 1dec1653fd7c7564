"""What queries mean, on small tables."""

import pytest

from millrace import api
from millrace.errors import BindingProblem, FunctionProblem, SourceProblem


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


def ids(engine, condition, table="gaps"):
    return sorted(r[0] for r in rows(engine, f"SELECT id FROM {table} WHERE {condition}"))


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ("age = 30", [1]),
        ("age != 30", [2, 3, 4]),  # null differs from any value
        ("age > 29", [1, 3]),
        ("NOT age > 29", [2, 4]),  # unknown is false, so its negation holds
        ("age IN (30, 35)", [1, 3]),
        ("age NOT IN (30, 35)", [2, 4]),
        ("age BETWEEN 28 AND 30", [1, 4]),
        ("age NOT BETWEEN 28 AND 30", [2, 3]),
        ("age IS NULL", [2]),
        ("salary IS NOT NULL", [1, 2, 4]),
        ("name LIKE 'A%'", [1]),
        ("name LIKE '%li%'", [1, 3]),
        ("name NOT LIKE '_o_'", [1, 3, 4]),
        ("active = true", [1, 3]),
        ("active != true", [2, 4]),
        ("active < true", []),
        ("age = salary", []),
        ("age < salary", [1, 4]),
        ("LENGTH(name) > 4", [1, 3, 4]),
        ("(age = 30 OR age = 35) AND salary = 50000", [1]),
        ("age = 30 OR age = 35 AND salary = 1", [1]),
        ("age + 5 = 35", [1]),
        ("id IN (SELECT user_id FROM orders)", [1, 3]),
        ("id NOT IN (SELECT user_id FROM orders)", [2, 4]),  # a null in the list spoils nothing
        ("age IN (SELECT user_id FROM orders WHERE order_id = 14)", [2]),  # null is in a list with null
        ("EXISTS (SELECT order_id FROM orders WHERE total > 7)", [1, 2, 3, 4]),
        ("NOT EXISTS (SELECT order_id FROM orders WHERE total > 70)", [1, 2, 3, 4]),
        ("EXISTS (SELECT order_id FROM orders WHERE total > 70) OR id = 2", [2]),
        ("score > (SELECT AVG(score) FROM gaps)", [1, 3]),
        ("CASE WHEN age IS NULL THEN true ELSE false END", [2]),
    ],
)
def test_filters(engine, condition, expected):
    assert ids(engine, condition) == expected


def test_correlated_exists(engine):
    assert rows(engine, "SELECT p.id FROM people p WHERE EXISTS (SELECT o.order_id FROM orders o WHERE o.user_id = p.id AND o.total > 6)") == [(1,)]


@pytest.mark.parametrize(
    ("text", "error", "message"),
    [
        ("SELECT nope FROM people", BindingProblem, "not found"),
        ("SELECT id FROM people WHERE name > 3", BindingProblem, "cannot compare"),
        ("SELECT id FROM people WHERE name IN (1)", BindingProblem, "cannot compare"),
        ("SELECT name, COUNT(*) FROM people GROUP BY age", BindingProblem, "must appear in GROUP BY"),
        ("SELECT id FROM people WHERE SUM(id) > 1", BindingProblem, "WHERE"),
        ("SELECT FOO(id) FROM people", FunctionProblem, "unknown function"),
        ("SELECT UPPER(name, name) FROM people", FunctionProblem, "at most 1"),
        ("SELECT REPLACE(name) FROM people", FunctionProblem, "at least 3"),
        ("SELECT NTILE(0) OVER (ORDER BY id) AS n FROM people", FunctionProblem, "positive"),
        ("SELECT LAG(id, -1) OVER (ORDER BY id) AS n FROM people", FunctionProblem, "non-negative"),
        ("SELECT LAG(id, 1, age) OVER (ORDER BY id) AS n FROM people", FunctionProblem, "literal"),
        ("SELECT * FROM people JOIN gaps ON id = id", BindingProblem, "collision"),
        ("WITH a AS (SELECT id FROM people), a AS (SELECT id FROM people) SELECT id FROM a", BindingProblem, "duplicate CTE"),
        ("WITH a AS (SELECT id FROM b), b AS (SELECT id FROM people) SELECT id FROM a", BindingProblem, "forward CTE"),
        ("WITH a AS (SELECT id FROM a) SELECT id FROM a", BindingProblem, "circular"),
        ("SELECT DATE_TRUNC('week', name) FROM people", FunctionProblem, "unknown unit"),
        ("SELECT id FROM /nowhere/x.parquet", SourceProblem, "no such file"),
        ("SELECT id FROM '/nowhere/*.parquet'", SourceProblem, "no files match"),
    ],
)
def test_errors(engine, text, error, message):
    with pytest.raises(error, match=message):
        engine.sql(text)


def test_names(engine):
    assert engine.sql("SELECT UPPER(name), 1, CASE WHEN id = 1 THEN 2 END, COUNT(*) OVER (PARTITION BY age) FROM people").columns == ["UPPER", "literal_1", "col_2", "COUNT"]
    assert engine.sql("SELECT COUNT(*), SUM(age) FROM people").columns == ["count", "sum"]
    assert engine.sql("SELECT * FROM orders o").columns == ["o.order_id", "o.user_id", "o.total"]
    assert engine.sql("SELECT o.total FROM orders o").columns == ["o.total"]
    assert engine.sql("SELECT COUNT(id), COUNT(age) FROM gaps").columns == ["count", "count_2"]


def test_dashed_columns(engine, spark):
    engine.register_table("d", spark.createDataFrame([(1, 5, 2)], "`a-b` int, a int, b int"))
    assert rows(engine, "SELECT a-b AS x, a - b AS y FROM d") == [(1, 3)]
    assert engine.sql("SELECT a-b FROM d").columns == ["a-b"]


def test_joins(engine):
    left = "SELECT p.id AS i, o.order_id AS k FROM people p {} JOIN orders o ON p.id = o.user_id"
    assert sorted(rows(engine, left.format(""))) == [(1, 10), (1, 11), (3, 12)]
    assert len(rows(engine, left.format("LEFT"))) == 7
    assert len(rows(engine, left.format("RIGHT OUTER"))) == 5
    assert len(rows(engine, left.format("FULL"))) == 9
    assert len(rows(engine, "SELECT p.id AS i FROM people p CROSS JOIN orders o")) == 30
    assert len(rows(engine, "SELECT a.id AS i FROM people a JOIN people b ON a.age < b.age")) == 11
    # null keys meet
    assert rows(engine, "SELECT COUNT(*) AS n FROM gaps g JOIN orders o ON g.age = o.user_id") == [(1,)]


def test_null_safe_join_is_hashed(engine):
    plan = engine.sql("SELECT p.id AS i FROM people p JOIN orders o ON p.id = o.user_id")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_aggregates(engine):
    assert rows(engine, "SELECT COUNT(*) AS n, COUNT(age) AS a, SUM(salary) AS s, MIN(name) AS lo FROM gaps") == [(4, 3, 147000.0, "Alice")]
    assert rows(engine, "SELECT age, COUNT(*) AS n, AVG(salary) AS s FROM people GROUP BY age ORDER BY age") == [(25, 2, 48500.0), (30, 3, 55000.0), (35, 1, 48000.0)]
    assert rows(engine, "SELECT age, COUNT(*) AS n FROM people GROUP BY age HAVING n > 1 AND MAX(salary) > 55000") == [(30, 3)]
    assert rows(engine, "SELECT COUNT(*) AS n, SUM(age) AS s FROM people WHERE age > 100") == [(0, None)]
    assert rows(engine, "SELECT age, COUNT(*) AS n FROM people WHERE age > 100 GROUP BY age") == []
    assert rows(engine, "SELECT SUM(ABS(0 - id)) AS s FROM people") == [(21.0,)]
    assert sorted(rows(engine, "SELECT age FROM people GROUP BY age")) == [(25,), (30,), (35,)]
    assert rows(engine, "SELECT MAX(age) - MIN(age) AS d FROM people") == [(10.0,)]
    assert rows(engine, "SELECT COUNT(*) AS n FROM people GROUP BY age ORDER BY SUM(salary) DESC LIMIT 1") == [(3,)]


def test_windows(engine):
    text = "SELECT id, RANK() OVER (ORDER BY age) AS r, DENSE_RANK() OVER (ORDER BY age) AS d, LAST_VALUE(id) OVER (PARTITION BY age ORDER BY id) AS l, NTH_VALUE(id, 2) OVER (PARTITION BY age ORDER BY id) AS n, LAG(id) OVER (ORDER BY id) AS p FROM people ORDER BY id"
    assert rows(engine, text) == [(1, 3, 2, 6, 3, None), (2, 1, 1, 4, 4, 1), (3, 3, 2, 6, 3, 2), (4, 1, 1, 4, 4, 3), (5, 6, 3, 5, None, 4), (6, 3, 2, 6, 3, 5)]
    assert rows(engine, "SELECT id, SUM(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM people ORDER BY id LIMIT 3") == [(1, 1.0), (2, 3.0), (3, 5.0)]
    assert {r[1] for r in rows(engine, "SELECT id, RANK() OVER (PARTITION BY active) AS r FROM people")} == {1}
    assert rows(engine, "SELECT age, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM people GROUP BY age ORDER BY r, age") == [(30, 1), (25, 2), (35, 3)]


def test_order_and_limit(engine):
    assert [r[0] for r in rows(engine, "SELECT id FROM gaps ORDER BY age, id")] == [2, 4, 1, 3]
    assert [r[0] for r in rows(engine, "SELECT id FROM gaps ORDER BY age DESC")] == [3, 1, 4, 2]
    assert rows(engine, "SELECT name FROM people ORDER BY salary DESC LIMIT 2 OFFSET 1") == [("Frank",), ("Diana",)]
    assert rows(engine, "SELECT id FROM people LIMIT 0") == []
    assert rows(engine, "SELECT DISTINCT age FROM people ORDER BY age DESC") == [(35,), (30,), (25,)]


def test_subqueries_and_ctes(engine):
    assert rows(engine, "SELECT t.a AS a FROM (SELECT age AS a, COUNT(*) AS n FROM people GROUP BY age) t WHERE t.n > 2") == [(30,)]
    assert rows(engine, "WITH x AS (SELECT id FROM people WHERE age = 25), y AS (SELECT id FROM x WHERE id > 2) SELECT id FROM y") == [(4,)]
    assert rows(engine, "SELECT (SELECT MAX(order_id) AS m FROM orders WHERE order_id > 99) AS m FROM people LIMIT 1") == [(None,)]
    with pytest.raises(Exception, match="(?i)more than one row"):
        rows(engine, "SELECT (SELECT order_id FROM orders) AS m FROM people")


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        ("SUBSTRING('abcdef', 0, 2)", "ab"),
        ("SUBSTRING('abcdef', 3)", "cdef"),
        ("SUBSTRING('abcdef', 2, -1)", ""),
        ("LENGTH('é')", 2),
        ("TRIM(' \\t x\\n')", "x"),
        ("SPLIT('a.b.', '.')", ["a", "b", ""]),
        ("SPLIT('abc', '')", ["a", "b", "c"]),
        ("REVERSE('añb')", "bña"),
        ("CONCAT('a', 1, 2.0, true)", "a12true"),
        ("REPEAT('ab', 2)", "abab"),
        ("ROUND(2.5)", 3.0),
        ("ROUND(-2.5)", -3.0),
        ("ROUND(1.005, 2)", 1.0),
        ("ROUND(1234.5, -2)", 1200.0),
        ("MOD(-7, 3)", -1.0),
        ("TRUNC(-2.7)", -2.0),
        ("SIGN(-3)", -1.0),
        ("MIN(3, 2)", 2.0),
        ("MAX('10', 9)", 10.0),
        ("DATE_ADD('2024-01-31', 1, 'month')", "2024-03-02T00:00:00Z"),
        ("DATE_ADD('2023-01-31T10:20:30', 1, 'month')", "2023-03-03T10:20:30Z"),
        ("DATE_ADD('2024-02-29', 1, 'year')", "2025-03-01T00:00:00Z"),
        ("DATE_SUB('2024-01-01 01:00:00', 2, 'hour')", "2023-12-31T23:00:00Z"),
        ("DATE_DIFF('2024-01-01T12:00:00', '2024-01-02')", -1),
        ("DATE_DIFF('2024-01-03', '2024-01-01T12:00:00')", 1),
        ("DATE_TRUNC('month', '2024-05-17 10:11:12')", "2024-05-01T00:00:00Z"),
        ("DATE_PART('second', '2024-05-17 10:11:12')", 12),
        ("YEAR('2024-05-17T10:11:12Z')", 2024),
        ("TO_DATE('2024-05-17 10:11:12')", "2024-05-17"),
        ("TRY_CAST('x', 'number')", None),
        ("TRY_CAST('x', 'what')", None),
        ("CAST('12', 'number')", 12.0),
        ("TO_STRING(50000.0)", "50000"),
        ("COALESCE(NULL, 'x')", "x"),
        ("NULLIF(1, 1)", None),
        ("'a' || 'b'", "ab"),
        ("7 % 4 * 2", 6),
    ],
)
def test_functions(engine, expr, expected):
    assert rows(engine, f"SELECT {expr} AS x FROM people LIMIT 1") == [(expected,)]


@pytest.mark.parametrize("expr", ["MOD(1, 0)", "SQRT(0 - 1)", "REPEAT('a', 0 - 1)", "REPEAT('aaaaaaaaaa', 2000000)", "YEAR('soon')", "CAST('x', 'number')"])
def test_function_errors(engine, expr):
    with pytest.raises(Exception, match="MOD|SQRT|REPEAT|parse|CAST"):
        rows(engine, f"SELECT {expr} AS x FROM people")


def test_library_calls(engine):
    df = engine.table("people")
    assert api.apply_filter(df, "age > 30").count() == 1
    assert api.apply_group_by(df, "age", "age, COUNT(*) AS n", "n > 2").collect()[0]["n"] == 3
    assert api.apply_limit_offset(api.apply_order_by(df, "id DESC"), 1, 1).collect()[0]["id"] == 5
    assert api.apply_distinct(api.apply_select_list(df, "age")).count() == 3


def test_custom_function(engine):
    from pyspark.sql import functions as F

    engine.register_function("TWICE", lambda s: F.concat(s, s))
    assert rows(engine, "SELECT twice(name) AS t FROM people WHERE id = 2") == [("BobBob",)]


def test_pushdown_and_pruning(spark, tmp_path):
    from millrace.engine import Engine

    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(path)
    plan = Engine(spark).sql(f"SELECT b FROM '{path}' WHERE id = 7 AND b > 3")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,b:bigint>" in plan
    assert "EqualNullSafe(id,7)" in plan or "EqualTo(id,7)" in plan


def test_dates_by_length(engine, spark):
    """Each accepted layout is read whatever its length suggests; what isn't one is refused."""
    texts = ["2024-01-31", "2024-01-31 10:20:30", "2024-01-31T10:20:30", "2024-01-31T10:20:30Z", "2024-01-31T10:20:30+02:00", None]
    engine.register_table("dates", spark.createDataFrame([(t,) for t in texts], "t string"))
    got = [r["y"] for r in engine.sql("SELECT DATE_ADD(t, 1, 'day') AS y FROM dates").collect()]
    assert got == ["2024-02-01T00:00:00Z", "2024-02-01T10:20:30Z", "2024-02-01T10:20:30Z", "2024-02-01T10:20:30Z", got[4], None] and got[4] is not None
    for wrong in ("2024-13-01", "2024/01/01", "2024-01-31x10:20:30", "31.1.2024", ""):
        engine.register_table("bad", spark.createDataFrame([(wrong,)], "t string"))
        with pytest.raises(Exception, match="cannot parse date"):
            engine.sql("SELECT YEAR(t) AS y FROM bad").collect()
