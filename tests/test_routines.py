import pytest

from tessera.dialects.lexer import SqlError
from tessera.dialects.routines import Raised, Routines


@pytest.fixture
def tables(spark):
    spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(9)], "id int, name string, grp int").createOrReplaceTempView("items")
    spark.createDataFrame([], "id int, note string").createOrReplaceTempView("audit")
    return spark


def rows(spark, sql):
    return [tuple(r) for r in spark.sql(sql).collect()]


def test_data_changes_in_a_block(tables):
    r = Routines(tables, "oracle")
    got = r.run("DECLARE n NUMBER; BEGIN INSERT INTO items VALUES (100, 'new', 7); UPDATE items SET name = name || '!' WHERE grp = 1; n := SQL%ROWCOUNT; DELETE FROM items WHERE id < 2; COMMIT; END;")
    assert got["n"] == 3
    assert rows(tables, "SELECT count(*), sum(id), count_if(name LIKE '%!') FROM items") == [(8, 135, 2)]


def test_procedures_and_functions(tables):
    r = Routines(tables, "oracle")
    r.create("CREATE OR REPLACE FUNCTION tax(x NUMBER) RETURN NUMBER IS y NUMBER; BEGIN IF x > 10 THEN y := x * 2; ELSE y := x; END IF; RETURN y + 1; END tax;")
    r.create("CREATE PROCEDURE add_item(p_id IN NUMBER, p_name VARCHAR2 DEFAULT 'x', total OUT NUMBER) AS BEGIN INSERT INTO items VALUES (p_id, p_name, tax(p_id)); SELECT COUNT(*) INTO total FROM items; END;")
    assert r.call("add_item", 50) == {"total": 10}
    assert rows(tables, "SELECT name, grp FROM items WHERE id = 50") == [("x", 101)]
    assert r.run("DECLARE t NUMBER; BEGIN add_item(60, total => t); END;")["t"] == 11
    m = Routines(tables, "mysql")
    m.create("CREATE PROCEDURE bump(INOUT n INT, IN k INT) BEGIN WHILE k > 0 DO SET n = n + 2, k = k - 1; END WHILE; END")
    assert m.call("bump", 1, 3) == {"n": 7}


def test_cursors_and_their_attributes(tables):
    sql = "DECLARE CURSOR c IS SELECT id, name FROM items ORDER BY id; a NUMBER; b VARCHAR2(9); s NUMBER := 0; k NUMBER; BEGIN OPEN c; LOOP FETCH c INTO a, b; EXIT WHEN c%NOTFOUND OR c%ROWCOUNT > 4; s := s + a; END LOOP; k := c%ROWCOUNT; CLOSE c; END;"
    got = Routines(tables, "oracle").run(sql)
    assert (got["s"], got["k"]) == (6, 5)
    got = Routines(tables, "oracle").run("DECLARE rc SYS_REFCURSOR; x NUMBER; BEGIN OPEN rc FOR SELECT MAX(id) FROM items; FETCH rc INTO x; CLOSE rc; END;")
    assert got["x"] == 8
    m = Routines(tables, "mysql")
    m.create("CREATE PROCEDURE total(OUT s INT) BEGIN DECLARE done INT DEFAULT 0; DECLARE v INT; DECLARE c CURSOR FOR SELECT id FROM items; DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1; SET s = 0; OPEN c; top: LOOP FETCH c INTO v; IF done = 1 THEN LEAVE top; END IF; SET s = s + v; END LOOP; CLOSE c; END")
    assert m.call("total") == {"s": 36}


def test_bulk_collect_and_forall(tables):
    r = Routines(tables, "oracle", keys={"items": ["id"]})
    got = r.run("DECLARE TYPE t IS TABLE OF NUMBER; ids t; names t; n NUMBER; BEGIN SELECT id, name BULK COLLECT INTO ids, names FROM items WHERE grp = 0 ORDER BY id; n := ids.COUNT; FORALL i IN 1..ids.COUNT INSERT INTO audit VALUES (ids(i), names(i)); FORALL i IN 1..ids.COUNT UPDATE items SET name = 'seen' WHERE id = ids(i); END;")
    assert got["n"] == 3 and got["ids"] == [0, 3, 6]
    assert sorted(rows(tables, "SELECT * FROM audit")) == [(0, "n0"), (3, "n3"), (6, "n6")]
    assert rows(tables, "SELECT count(*) FROM items WHERE name = 'seen'") == [(3,)]
    sql = "DECLARE ids t := t(1, 50, 50, 60); n NUMBER; k NUMBER; BEGIN FORALL i IN 1..ids.COUNT SAVE EXCEPTIONS INSERT INTO items VALUES (ids(i), 'new', 0); EXCEPTION WHEN OTHERS THEN n := SQL%BULK_EXCEPTIONS.COUNT; k := SQL%BULK_EXCEPTIONS(2).ERROR_INDEX; END;"
    got = r.run(sql)
    assert (got["n"], got["k"]) == (2, 3) and rows(tables, "SELECT count(*) FROM items WHERE id IN (50, 60)") == [(2,)]
    r.run("DECLARE ids t := t(0, 1, 2); BEGIN FORALL i IN 2..3 DELETE FROM items WHERE id = ids(i); END;")
    assert rows(tables, "SELECT min(id), count(*) FROM items WHERE id < 3") == [(0, 1)]


def test_handlers(tables):
    r = Routines(tables, "oracle", keys={"items": ["id"]})
    assert r.run("DECLARE x NUMBER; BEGIN SELECT id INTO x FROM items WHERE id = 99; EXCEPTION WHEN NO_DATA_FOUND THEN x := -1; END;")["x"] == -1
    assert r.run("DECLARE x NUMBER; BEGIN SELECT id INTO x FROM items; EXCEPTION WHEN TOO_MANY_ROWS OR ZERO_DIVIDE THEN x := -2; END;")["x"] == -2
    assert r.run("DECLARE x NUMBER := 0; BEGIN x := 1 / x; EXCEPTION WHEN ZERO_DIVIDE THEN x := -3; END;")["x"] == -3
    assert r.run("DECLARE x NUMBER; BEGIN INSERT INTO items VALUES (1, 'a', 1); EXCEPTION WHEN DUP_VAL_ON_INDEX THEN x := SQLCODE; END;")["x"] == -1
    got = r.run("DECLARE bad EXCEPTION; PRAGMA EXCEPTION_INIT(bad, -20007); m VARCHAR2(50); BEGIN BEGIN RAISE_APPLICATION_ERROR(-20007, 'seven'); END; EXCEPTION WHEN bad THEN m := SQLERRM; END;")
    assert got["m"] == "seven"
    with pytest.raises(Raised, match="out"):
        r.run("BEGIN BEGIN RAISE_APPLICATION_ERROR(-20001, 'out'); EXCEPTION WHEN OTHERS THEN RAISE; END; END;")
    m = Routines(tables, "mysql")
    m.create("CREATE PROCEDURE p(OUT s VARCHAR(20)) BEGIN DECLARE EXIT HANDLER FOR SQLSTATE '45001' SET s = 'caught'; SIGNAL SQLSTATE '45001' SET MESSAGE_TEXT = 'x'; SET s = 'not here'; END")
    assert m.call("p") == {"s": "caught"}


def test_collections_and_output(tables):
    r = Routines(tables, "oracle")
    got = r.run("DECLARE c t := t(5, 6); n NUMBER; m NUMBER; b NUMBER := 0; BEGIN c.EXTEND; c(3) := 7; c.EXTEND(2); c.TRIM(2); n := c.COUNT + c(3) * 10; m := c.LAST; IF c.EXISTS(3) AND NOT c.EXISTS(4) THEN b := 1; END IF; DBMS_OUTPUT.PUT_LINE('n is ' || n); END;")
    assert (got["n"], got["m"], got["b"], r.output) == (73, 3, 1, ["n is 73"])


def test_packages(tables):
    r = Routines(tables, "oracle")
    r.create("CREATE PACKAGE p AS total NUMBER := 10; PROCEDURE add(x NUMBER); FUNCTION now_at RETURN NUMBER; END p; / CREATE PACKAGE BODY p AS PROCEDURE add(x NUMBER) IS BEGIN total := total + x; END; FUNCTION now_at RETURN NUMBER IS BEGIN RETURN total; END; END p;")
    assert r.run("DECLARE a NUMBER; BEGIN p.add(5); p.add(7); a := p.now_at(); END;")["a"] == 22


def test_triggers(tables):
    r = Routines(tables, "mysql")
    r.create("CREATE TRIGGER b BEFORE INSERT ON items FOR EACH ROW BEGIN SET NEW.name = UPPER(NEW.name); IF NEW.grp IS NULL THEN SET NEW.grp = 9; END IF; END")
    r.create("CREATE TRIGGER a AFTER INSERT ON items FOR EACH ROW INSERT INTO audit VALUES (NEW.id, CONCAT('added ', NEW.name))")
    r.create("CREATE TRIGGER d AFTER DELETE ON items FOR EACH ROW INSERT INTO audit VALUES (OLD.id, 'gone')")
    r.run("BEGIN INSERT INTO items (id, name, grp) VALUES (20, 'abc', NULL), (21, 'x', 1); DELETE FROM items WHERE id = 3; END")
    assert sorted(rows(tables, "SELECT * FROM items WHERE id > 9")) == [(20, "ABC", 9), (21, "X", 1)]
    assert sorted(rows(tables, "SELECT * FROM audit")) == [(3, "gone"), (20, "added ABC"), (21, "added X")]


def test_dynamic_sql(tables):
    r = Routines(tables, "oracle")
    got = r.run("DECLARE x NUMBER; BEGIN EXECUTE IMMEDIATE 'SELECT COUNT(*) FROM items WHERE grp = :1 AND id > :2' INTO x USING 1, 2; EXECUTE IMMEDIATE 'DELETE FROM items WHERE id = :a' USING 8; END;")
    assert got["x"] == 2 and rows(tables, "SELECT max(id) FROM items") == [(7,)]


def test_returning(tables):
    got = Routines(tables, "oracle").run("DECLARE n VARCHAR2(20); BEGIN UPDATE items SET name = 'z' || id WHERE id = 4 RETURNING name INTO n; END;")
    assert got["n"] == "z4"


def test_what_is_not_supported(tables):
    r = Routines(tables, "oracle")
    for bad in ("BEGIN GOTO x; END;", "BEGIN nothing_known(1); END;", "BEGIN x := 1; END;"):
        with pytest.raises(SqlError):
            r.run(bad)
