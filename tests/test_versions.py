"""Functions as expressions, triggers with both rows, versions: small cases beside the queries that equal DuckDB."""

import pytest

from tessera.dialects import inline
from tessera.dialects.lexer import SqlError
from tessera.dialects.routines import Raised, Routines
from tessera.operators.versions import CHAIN


@pytest.fixture
def r(spark):
    spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(12)], "id int, grp int, name string").createOrReplaceTempView("things")
    spark.createDataFrame([], "id int, note string").createOrReplaceTempView("seen")
    return Routines(spark, "oracle")


def rows(spark, sql):
    return sorted(map(tuple, spark.sql(sql).collect()), key=repr)


def test_functions_over_null_and_branches(spark, r):
    r.create("CREATE FUNCTION kind(n INTEGER) RETURN VARCHAR2 IS t VARCHAR2(9) := 'none'; BEGIN IF n > 5 THEN t := 'high'; ELSIF n > 2 THEN RETURN 'mid'; END IF; IF n IS NULL THEN t := t || '!'; END IF; RETURN t; END;")
    got = {x.id: x.k for x in r.query("SELECT id, kind(CASE WHEN id = 1 THEN NULL ELSE id END) AS k FROM things").collect()}
    assert got == {i: "none!" if i == 1 else "high" if i > 5 else "mid" if i > 2 else "none" for i in range(12)}
    assert r.query("SELECT MAX(kind(grp)) AS m, kind(MAX(id)) AS k FROM things").first() == ("none", "high")
    assert r.call("kind", 4) == "mid"


def test_folds(spark, r):
    r.create("CREATE FUNCTION fib(n INTEGER) RETURN INTEGER IS a INTEGER := 0; b INTEGER := 1; c INTEGER; BEGIN FOR i IN 1 .. n LOOP c := a + b; a := b; b := c; END LOOP; RETURN a; END;")
    r.create("CREATE FUNCTION spelt(s VARCHAR2) RETURN VARCHAR2 IS t VARCHAR2(30) := ''; BEGIN FOR i IN REVERSE 1 .. LENGTH(s) LOOP t := t || SUBSTR(s, i, 1); END LOOP; RETURN t; END;")
    got = {x.id: (x.f, x.s) for x in r.query("SELECT id, fib(id) AS f, spelt(name) AS s FROM things").collect()}
    fib = [0, 1]
    while len(fib) < 12:
        fib.append(sum(fib[-2:]))
    assert got == {i: (fib[i], f"n{i}"[::-1]) for i in range(12)}


@pytest.mark.parametrize(
    ("body", "what"),
    [
        ("BEGIN WHILE n > 0 LOOP RETURN 1; END LOOP; RETURN 0; END;", "WHILE"),
        ("x NUMBER; BEGIN SELECT 1 INTO x FROM dual; RETURN x; END;", "SELECT"),
        ("BEGIN FOR i IN 1 .. 3 LOOP RETURN i; END LOOP; RETURN 0; END;", "loop"),
        ("BEGIN IF n > 0 THEN NULL; END IF; END;", "RETURN"),
        ("BEGIN y := 1; RETURN 2; END;", "y"),
    ],
)
def test_functions_that_are_no_expression(body, what):
    with pytest.raises(SqlError, match=what):
        inline.function(f"CREATE FUNCTION f(n NUMBER) RETURN NUMBER IS {body}", "oracle")


def test_a_function_that_calls_itself(spark, r):
    r.create("CREATE FUNCTION down(n INTEGER) RETURN INTEGER IS BEGIN IF n <= 0 THEN RETURN 0; END IF; RETURN down(n - 1); END;")
    assert r.call("down", 3) == 0
    with pytest.raises((SqlError, RecursionError)):
        r.query("SELECT down(id) AS d FROM things")


def test_rollback_keeps_what_came_before(spark, r):
    r.run("BEGIN UPDATE things SET name = 'x' WHERE id = 1; SAVEPOINT s; DELETE FROM things WHERE id > 2; ROLLBACK TO s; DELETE FROM things WHERE id = 11; END;")
    assert rows(spark, "SELECT id FROM things WHERE name = 'x' OR id > 9") == [(1,), (10,)]
    r.run("BEGIN ROLLBACK; END;")
    assert rows(spark, "SELECT count(*), count_if(name = 'x') FROM things") == [(12, 0)]
    with pytest.raises(Raised, match="never set"):
        r.run("BEGIN ROLLBACK TO nowhere; END;")


def test_a_handler_takes_an_unknown_savepoint_and_work_goes_on(spark, r):
    r.run("BEGIN DELETE FROM things WHERE id = 0; ROLLBACK TO nowhere; EXCEPTION WHEN OTHERS THEN INSERT INTO seen VALUES (1, 'caught'); END;")
    assert rows(spark, "SELECT * FROM seen") == [(1, "caught")] and rows(spark, "SELECT count(*) FROM things") == [(11,)]


def test_versions_by_number_and_time(spark, r):
    r.run("BEGIN DELETE FROM things WHERE id = 0; END;")
    between = r.versions.log["things"][-1].at
    r.run("BEGIN DELETE FROM things WHERE id < 6; COMMIT; END;")
    count = lambda at: r.query(f"SELECT COUNT(*) AS n FROM things AS OF {at} t").first().n
    assert (count("SCN 0"), count("SCN 1"), count("SCN 2"), count(f"TIMESTAMP TIMESTAMP '{between.isoformat(' ')}'")) == (12, 11, 6, 11)
    with pytest.raises(Raised):
        count("SCN -1")


def test_updates_write_their_rows_and_long_chains_are_written_whole(spark, r):
    depths = []
    for k in range(CHAIN + 2):
        r.run(f"BEGIN UPDATE things SET grp = grp + 1 WHERE id = {k}; END;")
        depths.append(r.versions.log["things"][-1].depth)
    assert depths == [*range(1, CHAIN), 0, 1, 2]
    assert rows(spark, "SELECT sum(grp) FROM things") == [(sum(i % 3 for i in range(12)) + CHAIN + 2,)]
    r.run("BEGIN UPDATE things SET name = SYS_GUID(); END;")
    assert r.versions.log["things"][-1].depth == 0
    assert rows(spark, "SELECT name FROM things") == rows(spark, "SELECT name FROM things")


def test_triggers_fire_for_their_columns_alone(spark, r):
    r.create("CREATE TRIGGER t AFTER UPDATE OF grp ON things FOR EACH ROW BEGIN INSERT INTO seen VALUES (:OLD.grp, :NEW.name); END;")
    r.run("BEGIN UPDATE things SET name = 'q' WHERE id = 5; UPDATE things SET grp = 7 WHERE id IN (SELECT id FROM things WHERE id = 5); END;")
    assert rows(spark, "SELECT * FROM seen") == [(2, "q")]


def test_trigger_forms_that_are_errors(r):
    for bad in (
        "CREATE TRIGGER t BEFORE UPDATE ON things FOR EACH ROW BEGIN INSERT INTO seen VALUES (1, 'a'); END;",
        "CREATE TRIGGER t AFTER UPDATE ON things FOR EACH ROW BEGIN :NEW.grp := 1; END;",
        "CREATE TRIGGER t FOR UPDATE ON things COMPOUND TRIGGER n NUMBER := 0; AFTER EACH ROW IS BEGIN n := 2 * n; END AFTER EACH ROW; END t;",
    ):
        with pytest.raises(SqlError):
            r.create(bad)


def test_mysql_upsert_fires_for_old_and_new(spark):
    spark.createDataFrame([(1, 10), (2, 20)], "k int, v int").createOrReplaceTempView("stock")
    spark.createDataFrame([], "id int, note string").createOrReplaceTempView("seen")
    r = Routines(spark, "mysql", keys={"stock": ["k"]})
    r.create("CREATE TRIGGER t AFTER UPDATE ON stock FOR EACH ROW INSERT INTO seen VALUES (NEW.k, CONCAT(OLD.v, '>', NEW.v))")
    r.run("BEGIN UPDATE stock SET v = v + 1; END")
    assert rows(spark, "SELECT * FROM seen") == [(1, "10>11"), (2, "20>21")]
