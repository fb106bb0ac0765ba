"""Named queries for stored routines: data changes in blocks, procedures, cursors, collections, handlers, packages, triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialects.routines import Raised, Routines


def _session(spark: SparkSession, d: str, dialect: str = "oracle") -> Routines:
    from .queries import views

    views(spark, d, ("nation", "region", "customer", "orders"))
    spark.createDataFrame([], "id int, note string").createOrReplaceTempView("audit")
    return Routines(spark, dialect, keys={"nation": ["n_nationkey"], "region": ["r_regionkey"]})


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(int(v) if not isinstance(v, str) else v for v in values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))


def block_data_changes(spark, d):
    r = _session(spark, d)
    r.run("BEGIN INSERT INTO region VALUES (9, 'NINTH'); UPDATE region SET r_name = r_name || '!' WHERE r_regionkey < 2; DELETE FROM region WHERE r_regionkey = 3; COMMIT; END;")
    return spark.table("region")


def block_merge(spark, d):
    r = _session(spark, d)
    r.run("BEGIN MERGE INTO region t USING (SELECT r_regionkey + 2 AS k, r_name AS nm FROM region) s ON (t.r_regionkey = s.k) WHEN MATCHED THEN UPDATE SET t.r_name = s.nm WHEN NOT MATCHED THEN INSERT (r_regionkey, r_name) VALUES (s.k, s.nm); END;")
    return spark.table("region")


def block_rowcount(spark, d):
    got = _session(spark, d).run("DECLARE a NUMBER; b NUMBER; BEGIN UPDATE nation SET n_name = 'x' WHERE n_regionkey = 2; a := SQL%ROWCOUNT; DELETE FROM nation WHERE n_nationkey = 999; IF SQL%NOTFOUND THEN b := 1; END IF; END;")
    return _one(spark, changed=got["a"], none_found=got["b"])


def procedure_out_params(spark, d):
    r = _session(spark, d)
    r.create("CREATE PROCEDURE spread(seg IN VARCHAR2, low OUT NUMBER, high OUT NUMBER) AS BEGIN SELECT MIN(c_custkey), MAX(c_custkey) INTO low, high FROM customer WHERE c_mktsegment = seg; END;")
    return _one(spark, **r.call("spread", "BUILDING"))


def procedure_inout(spark, d):
    r = _session(spark, d, "mysql")
    r.create("CREATE PROCEDURE bump(INOUT n INT, IN k INT) BEGIN WHILE k > 0 DO SET n = n + 2; SET k = k - 1; END WHILE; END")
    return _one(spark, **r.call("bump", 1, 5))


def function_of_statements(spark, d):
    r = _session(spark, d)
    r.create("CREATE FUNCTION rest(a NUMBER, b NUMBER) RETURN NUMBER IS x NUMBER := a; BEGIN WHILE x >= b LOOP x := x - b; END LOOP; RETURN x; END;")
    r.run("BEGIN INSERT INTO region VALUES (100 + rest(17, 5), 'rest'); END;")
    return spark.table("region").where("r_regionkey > 99")


def cursor_attributes(spark, d):
    sql = "DECLARE CURSOR c IS SELECT n_nationkey FROM nation ORDER BY n_nationkey; v NUMBER; s NUMBER := 0; k NUMBER; o NUMBER := 0; BEGIN OPEN c; LOOP FETCH c INTO v; EXIT WHEN c%NOTFOUND OR c%ROWCOUNT > 10; s := s + v; END LOOP; k := c%ROWCOUNT; IF c%ISOPEN THEN o := 1; END IF; CLOSE c; END;"
    got = _session(spark, d).run(sql)
    return _one(spark, total=got["s"], fetched=got["k"], was_open=got["o"])


def cursor_open_for(spark, d):
    got = _session(spark, d).run("DECLARE rc SYS_REFCURSOR; a NUMBER; b NUMBER; BEGIN OPEN rc FOR SELECT MAX(o_orderkey) FROM orders; FETCH rc INTO a; CLOSE rc; OPEN rc FOR SELECT COUNT(*) FROM customer; FETCH rc INTO b; CLOSE rc; END;")
    return _one(spark, top=got["a"], customers=got["b"])


def cursor_not_found_handler(spark, d):
    r = _session(spark, d, "mysql")
    r.create("CREATE PROCEDURE total(OUT s INT) BEGIN DECLARE done INT DEFAULT 0; DECLARE v INT; DECLARE c CURSOR FOR SELECT n_nationkey FROM nation; DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1; SET s = 0; OPEN c; top: LOOP FETCH c INTO v; IF done = 1 THEN LEAVE top; END IF; SET s = s + v; END LOOP; CLOSE c; END")
    return _one(spark, **r.call("total"))


def bulk_collect_forall(spark, d):
    r = _session(spark, d)
    r.run("DECLARE ids t; names t; BEGIN SELECT n_nationkey, n_name BULK COLLECT INTO ids, names FROM nation WHERE n_regionkey = 1; FORALL i IN 1..ids.COUNT INSERT INTO audit VALUES (ids(i), names(i)); END;")
    return spark.table("audit")


def forall_update_delete(spark, d):
    r = _session(spark, d)
    r.run("DECLARE ids t; BEGIN SELECT n_nationkey BULK COLLECT INTO ids FROM nation WHERE n_regionkey = 4; FORALL i IN 1..ids.COUNT UPDATE nation SET n_name = 'seen' WHERE n_nationkey = ids(i); SELECT n_nationkey BULK COLLECT INTO ids FROM nation WHERE n_regionkey = 0; FORALL i IN 1..ids.COUNT DELETE FROM nation WHERE n_nationkey = ids(i); END;")
    return spark.table("nation")


def forall_save_exceptions(spark, d):
    sql = "DECLARE ids t := t(1, 50, 50, 60); n NUMBER; k NUMBER; BEGIN FORALL i IN 1..ids.COUNT SAVE EXCEPTIONS INSERT INTO region VALUES (ids(i), 'new'); EXCEPTION WHEN OTHERS THEN n := SQL%BULK_EXCEPTIONS.COUNT; k := SQL%BULK_EXCEPTIONS(2).ERROR_INDEX; END;"
    got = _session(spark, d).run(sql)
    return _one(spark, errors=got["n"], second_at=got["k"], kept=spark.table("region").count())


def collection_methods(spark, d):
    got = _session(spark, d).run("DECLARE c t := t(5, 6); n NUMBER; l NUMBER; b NUMBER := 0; BEGIN c.EXTEND; c(3) := 7; c.EXTEND(2); c.TRIM(2); n := c.COUNT + c(3) * 10; l := c.LAST; IF c.EXISTS(3) AND NOT c.EXISTS(4) THEN b := 1; END IF; END;")
    return _one(spark, n=got["n"], last_at=got["l"], there=got["b"])


def named_exceptions(spark, d):
    r = _session(spark, d)
    a = r.run("DECLARE x NUMBER; BEGIN SELECT n_nationkey INTO x FROM nation WHERE n_nationkey = 999; EXCEPTION WHEN NO_DATA_FOUND THEN x := 1; END;")["x"]
    b = r.run("DECLARE x NUMBER; BEGIN SELECT n_nationkey INTO x FROM nation; EXCEPTION WHEN TOO_MANY_ROWS THEN x := 2; END;")["x"]
    c = r.run("DECLARE x NUMBER := 0; BEGIN x := 1 / x; EXCEPTION WHEN ZERO_DIVIDE THEN x := 3; END;")["x"]
    e = r.run("DECLARE x NUMBER; BEGIN INSERT INTO nation VALUES (1, 'again', 1); EXCEPTION WHEN DUP_VAL_ON_INDEX THEN x := 4; END;")["x"]
    return _one(spark, no_data=a, too_many=b, zero=c, dup=e)


def exception_init(spark, d):
    got = _session(spark, d).run("DECLARE bad EXCEPTION; PRAGMA EXCEPTION_INIT(bad, -20007); m VARCHAR2(50); BEGIN RAISE_APPLICATION_ERROR(-20007, 'seven'); EXCEPTION WHEN bad THEN m := SQLERRM || '/' || SQLCODE; END;")
    return _one(spark, said=got["m"])


def signal_resignal(spark, d):
    r = _session(spark, d, "mysql")
    r.create("CREATE PROCEDURE inner_p() BEGIN DECLARE EXIT HANDLER FOR SQLSTATE '45001' RESIGNAL SET MESSAGE_TEXT = 'told again'; SIGNAL SQLSTATE '45001' SET MESSAGE_TEXT = 'first'; END")
    try:
        r.call("inner_p")
    except Raised as e:
        return _one(spark, said=e.text)
    raise AssertionError("nothing was raised")


def package_state(spark, d):
    r = _session(spark, d)
    r.create("CREATE PACKAGE p AS total NUMBER := 10; PROCEDURE add(x NUMBER); FUNCTION now_at RETURN NUMBER; END p; / CREATE PACKAGE BODY p AS PROCEDURE add(x NUMBER) IS BEGIN total := total + x; END; FUNCTION now_at RETURN NUMBER IS BEGIN RETURN total; END; END p;")
    return _one(spark, total=r.run("DECLARE a NUMBER; BEGIN p.add(5); p.add(7); a := p.now_at(); END;")["a"])


def triggers_before_after(spark, d):
    r = _session(spark, d, "mysql")
    r.create("CREATE TRIGGER b BEFORE INSERT ON region FOR EACH ROW BEGIN SET NEW.r_name = UPPER(NEW.r_name); IF NEW.r_regionkey IS NULL THEN SET NEW.r_regionkey = 77; END IF; END")
    r.create("CREATE TRIGGER a AFTER INSERT ON region FOR EACH ROW INSERT INTO audit VALUES (NEW.r_regionkey, CONCAT('added ', NEW.r_name))")
    r.create("CREATE TRIGGER d AFTER DELETE ON region FOR EACH ROW INSERT INTO audit VALUES (OLD.r_regionkey, 'gone')")
    r.run("BEGIN INSERT INTO region (r_regionkey, r_name) VALUES (NULL, 'abc'), (78, 'x'); DELETE FROM region WHERE r_regionkey = 3; END")
    return spark.table("audit")


def dynamic_changes(spark, d):
    r = _session(spark, d)
    r.run("DECLARE n NUMBER; BEGIN EXECUTE IMMEDIATE 'DELETE FROM region WHERE r_regionkey = :a OR r_name = :b' USING 2, 'AFRICA'; EXECUTE IMMEDIATE 'INSERT INTO region VALUES (:1, :2)' USING 40, 'forty'; END;")
    return spark.table("region")


def output_lines(spark, d):
    r = _session(spark, d)
    r.run("BEGIN FOR r IN (SELECT r_name FROM region ORDER BY r_regionkey) LOOP DBMS_OUTPUT.PUT_LINE('>' || r.r_name); END LOOP; END;")
    return spark.createDataFrame([(x,) for x in r.output], "line string")


_ALL = (
    block_data_changes, block_merge, block_rowcount, procedure_out_params, procedure_inout, function_of_statements, cursor_attributes, cursor_open_for, cursor_not_found_handler, bulk_collect_forall, forall_update_delete,
    forall_save_exceptions, collection_methods, named_exceptions, exception_init, signal_resignal, package_state, triggers_before_after, dynamic_changes, output_lines,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    big = lambda **kv: "SELECT " + ", ".join(f"CAST({v} AS {'VARCHAR' if str(v).startswith(chr(39)) else 'BIGINT'}) AS {k}" for k, v in kv.items())
    return {
        "block_data_changes": "SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN r_name || '!' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT CAST(9 AS INTEGER), 'NINTH'",
        "block_merge": "SELECT r.r_regionkey, coalesce(s.r_name, r.r_name) AS r_name FROM region r LEFT JOIN region s ON s.r_regionkey + 2 = r.r_regionkey UNION ALL SELECT r_regionkey + 2, r_name FROM region WHERE r_regionkey + 2 NOT IN (SELECT r_regionkey FROM region)",
        "block_rowcount": "SELECT count(*) AS changed, CAST(1 AS BIGINT) AS none_found FROM nation WHERE n_regionkey = 2",
        "procedure_out_params": "SELECT min(c_custkey) AS low, max(c_custkey) AS high FROM customer WHERE c_mktsegment = 'BUILDING'",
        "procedure_inout": big(n=11),
        "function_of_statements": "SELECT CAST(102 AS INTEGER) AS r_regionkey, 'rest' AS r_name",
        "cursor_attributes": "SELECT CAST(sum(n_nationkey) AS BIGINT) AS total, CAST(11 AS BIGINT) AS fetched, CAST(1 AS BIGINT) AS was_open FROM (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10)",
        "cursor_open_for": "SELECT max(o_orderkey) AS top, (SELECT count(*) FROM customer) AS customers FROM orders",
        "cursor_not_found_handler": "SELECT CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation",
        "bulk_collect_forall": "SELECT n_nationkey AS id, n_name AS note FROM nation WHERE n_regionkey = 1",
        "forall_update_delete": "SELECT n_nationkey, CASE WHEN n_regionkey = 4 THEN 'seen' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 0",
        "forall_save_exceptions": "SELECT CAST(2 AS BIGINT) AS errors, CAST(3 AS BIGINT) AS second_at, count(*) + 2 AS kept FROM region",
        "collection_methods": big(n=73, last_at=3, there=1),
        "named_exceptions": big(no_data=1, too_many=2, zero=3, dup=4),
        "exception_init": big(said="'seven/-20007'"),
        "signal_resignal": big(said="'told again'"),
        "package_state": big(total=22),
        "triggers_before_after": "SELECT CAST(77 AS INTEGER) AS id, 'added ABC' AS note UNION ALL SELECT 78, 'added X' UNION ALL SELECT 3, 'gone'",
        "dynamic_changes": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2 AND r_name <> 'AFRICA' UNION ALL SELECT CAST(40 AS INTEGER), 'forty'",
        "output_lines": "SELECT '>' || r_name AS line FROM region",
    }
