"""Named queries for functions over rows, triggers that see both rows, and versions of tables, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialects.routines import Routines


def _session(spark: SparkSession, d: str, dialect: str = "oracle") -> Routines:
    from .queries import views

    views(spark, d, ("nation", "region", "customer", "orders", "lineitem", "supplier"))
    spark.createDataFrame([], "id bigint, was double, now double, what string").createOrReplaceTempView("history")
    return Routines(spark, dialect, keys={"nation": ["n_nationkey"], "region": ["r_regionkey"], "orders": ["o_orderkey"]})


# --- functions over rows ------------------------------------------------------------


def function_over_rows(spark, d):
    """Branches, early returns, defaults and a function that calls another, summed over a table."""
    r = _session(spark, d)
    r.create("CREATE FUNCTION band(p NUMBER, step NUMBER DEFAULT 50000) RETURN NUMBER IS n NUMBER := 0; BEGIN IF p IS NULL THEN RETURN -1; ELSIF p < step THEN n := 1; ELSIF p < 2 * step THEN n := 2; ELSE RETURN 9; END IF; n := n * 10; RETURN n + 1; END;")
    r.create("CREATE FUNCTION rated(p NUMBER, s VARCHAR2) RETURN NUMBER IS BEGIN CASE s WHEN 'F' THEN RETURN band(p); WHEN 'O' THEN RETURN band(p, 100000); ELSE NULL; END CASE; RETURN 0; END;")
    return r.query("SELECT o_orderpriority, SUM(rated(o_totalprice, o_orderstatus)) AS s, MAX(band(o_totalprice)) AS m FROM orders GROUP BY o_orderpriority")


def function_loop_over_rows(spark, d):
    """Counted loops, one inside another, as folds: Luhn's sum of a key's digits and a small power."""
    r = _session(spark, d)
    r.create(
        "CREATE FUNCTION luhn(k NUMBER) RETURN INTEGER IS t VARCHAR2(20) := TO_CHAR(k); s INTEGER := 0; v INTEGER; BEGIN FOR i IN REVERSE 1 .. LENGTH(t) LOOP v := SUBSTR(t, i, 1); IF MOD(LENGTH(t) - i, 2) = 1 THEN v := 2 * v; IF v > 9 THEN v := v - 9; END IF; END IF; s := s + v; END LOOP; RETURN MOD(s, 10); END;"
    )
    r.create("CREATE FUNCTION stairs(n INTEGER) RETURN INTEGER IS s INTEGER := 0; BEGIN FOR i IN 1 .. n LOOP FOR j IN 1 .. i LOOP s := s + j; END LOOP; END LOOP; RETURN s; END;")
    return r.query("SELECT c_custkey, CAST(luhn(c_custkey) AS BINARY_DOUBLE) AS l, CAST(stairs(c_nationkey) AS BINARY_DOUBLE) AS s FROM customer WHERE luhn(c_custkey) < 7")


def my_function_over_rows(spark, d):
    r = _session(spark, d, "mysql")
    r.create("CREATE FUNCTION net(price DECIMAL(12,2), rate DECIMAL(4,2)) RETURNS DECIMAL(18,2) DETERMINISTIC BEGIN DECLARE kept DECIMAL(18,4) DEFAULT price; IF rate > 0.05 THEN SET kept = price * (1 - rate); END IF; RETURN ROUND(kept, 2); END")
    return r.query("SELECT l_returnflag, CAST(SUM(net(l_extendedprice, l_discount)) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag")


# --- triggers -----------------------------------------------------------------------


def trigger_update_audit(spark, d):
    """AFTER UPDATE OF a column: the old and the new value of each row that changed, under a condition."""
    r = _session(spark, d)
    r.create("CREATE TRIGGER audit_price AFTER UPDATE OF o_totalprice ON orders FOR EACH ROW WHEN (NEW.o_totalprice > OLD.o_totalprice) BEGIN INSERT INTO history VALUES (:OLD.o_orderkey, :OLD.o_totalprice, :NEW.o_totalprice, 'up'); END;")
    r.run("BEGIN UPDATE orders SET o_totalprice = o_totalprice * CASE WHEN MOD(o_orderkey, 2) = 0 THEN 2 ELSE 0.5 END WHERE o_orderstatus = 'P'; UPDATE orders SET o_orderpriority = 'x' WHERE o_orderkey < 100; END;")
    return spark.table("history").selectExpr("id", "round(was, 2) AS was", "round(now, 2) AS now", "what")


def trigger_all_events(spark, d):
    """One trigger for three events, which it tells apart, over a MERGE's rows too."""
    r = _session(spark, d)
    r.create(
        "CREATE TRIGGER watch AFTER INSERT OR UPDATE OR DELETE ON nation FOR EACH ROW BEGIN IF INSERTING THEN INSERT INTO history VALUES (:NEW.n_nationkey, NULL, :NEW.n_regionkey, 'in'); ELSIF UPDATING('n_regionkey') THEN INSERT INTO history VALUES (:NEW.n_nationkey, :OLD.n_regionkey, :NEW.n_regionkey, 'moved'); "
        "ELSIF DELETING THEN INSERT INTO history VALUES (:OLD.n_nationkey, :OLD.n_regionkey, NULL, 'out'); ELSE INSERT INTO history VALUES (:NEW.n_nationkey, 0, 0, 'else'); END IF; END;"
    )
    r.run(
        "BEGIN DELETE FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2); UPDATE nation SET n_regionkey = n_regionkey + 1 WHERE n_nationkey < 6; UPDATE nation SET n_name = 'x' WHERE n_nationkey = 7; "
        "MERGE INTO nation t USING (SELECT n_nationkey + 20 AS k, n_name AS nm FROM nation WHERE n_regionkey = 3) s ON (t.n_nationkey = s.k) WHEN MATCHED THEN UPDATE SET t.n_regionkey = 9 WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name, n_regionkey) VALUES (s.k, s.nm, 7); END;"
    )
    return spark.table("history")


def trigger_compound(spark, d):
    """Sections before and after the statement around row sections that add up; the variables are new for each statement."""
    r = _session(spark, d)
    r.create(
        "CREATE TRIGGER summed FOR UPDATE OR DELETE ON orders COMPOUND TRIGGER n NUMBER; diff NUMBER := 0; "
        "BEFORE STATEMENT IS BEGIN n := 100; END BEFORE STATEMENT; "
        "AFTER EACH ROW IS BEGIN n := n + 1; IF UPDATING THEN diff := diff + (:NEW.o_custkey - :OLD.o_custkey); END IF; END AFTER EACH ROW; "
        "AFTER STATEMENT IS BEGIN INSERT INTO history VALUES (n, diff, NULL, 'sum'); END AFTER STATEMENT; END summed;"
    )
    r.run("BEGIN UPDATE orders SET o_custkey = o_custkey + MOD(o_orderkey, 5) WHERE o_orderstatus = 'F'; DELETE FROM orders WHERE o_orderstatus = 'P'; END;")
    return spark.table("history").selectExpr("id", "was", "what")


def trigger_statement(spark, d):
    """A statement trigger fires once, whatever number of rows, and sees the table as it is then."""
    r = _session(spark, d)
    r.create("CREATE TRIGGER counted AFTER DELETE ON customer BEGIN INSERT INTO history SELECT COUNT(*), MIN(c_custkey), MAX(c_custkey), 'left' FROM customer; END;")
    r.run("BEGIN DELETE FROM customer WHERE c_nationkey < 5; DELETE FROM customer WHERE c_custkey = -1; END;")
    return spark.table("history")


# --- versions -----------------------------------------------------------------------


def block_rollback(spark, d):
    r = _session(spark, d)
    r.run("BEGIN UPDATE nation SET n_name = n_name || '?'; COMMIT; DELETE FROM nation WHERE n_regionkey = 1; INSERT INTO nation (n_nationkey, n_name) VALUES (90, 'NEW'); ROLLBACK; UPDATE nation SET n_regionkey = 8 WHERE n_nationkey = 3; END;")
    return spark.table("nation").select("n_nationkey", "n_name", "n_regionkey")


def block_savepoints(spark, d):
    """Back to a savepoint over two tables; work before it and after the return stays."""
    r = _session(spark, d)
    r.run("BEGIN INSERT INTO region VALUES (20, 'a'); SAVEPOINT one; DELETE FROM region WHERE r_regionkey < 3; UPDATE supplier SET s_acctbal = 0; SAVEPOINT two; INSERT INTO region VALUES (21, 'b'); ROLLBACK TO SAVEPOINT one; INSERT INTO region VALUES (22, 'c'); COMMIT; END;")
    return spark.table("region").crossJoin(spark.table("supplier").selectExpr("round(sum(s_acctbal), 2) AS balance"))


def flashback_as_of(spark, d):
    """A table beside what it was at two points of the log."""
    r = _session(spark, d)
    r.run("BEGIN DELETE FROM orders WHERE o_orderstatus = 'P'; UPDATE orders SET o_orderstatus = 'Z' WHERE o_orderkey < 1000; END;")
    return r.query(
        "SELECT o_orderstatus, SUM(now) AS now, SUM(middle) AS middle, SUM(first) AS first FROM (SELECT o_orderstatus, 1 AS now, 0 AS middle, 0 AS first FROM orders UNION ALL SELECT o_orderstatus, 0, 1, 0 FROM orders AS OF SCN 1 UNION ALL SELECT o_orderstatus, 0, 0, 1 FROM orders AS OF SCN 0 o) GROUP BY o_orderstatus"
    )


def many_inserts(spark, d):
    """A loop of inserts writes a row each, not the table."""
    r = _session(spark, d)
    r.run("BEGIN FOR i IN 1 .. 12 LOOP INSERT INTO region VALUES (100 + i, 'r' || i); END LOOP; END;")
    last = r.versions.log["region"][-1]
    if len(last.added) != 12:
        raise AssertionError(f"{len(last.added)} folders for 12 inserts")
    return spark.table("region")


_ALL = (function_over_rows, function_loop_over_rows, my_function_over_rows, trigger_update_audit, trigger_all_events, trigger_compound, trigger_statement, block_rollback, block_savepoints, flashback_as_of, many_inserts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_BAND = "CASE WHEN {p} IS NULL THEN -1 WHEN {p} < {s} THEN 11 WHEN {p} < 2 * {s} THEN 21 ELSE 9 END"


def oracle_sql() -> dict[str, str]:
    low, high = _BAND.format(p="o_totalprice", s=50000), _BAND.format(p="o_totalprice", s=100000)
    moved = "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 6 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 2"
    return {
        "function_over_rows": f"SELECT o_orderpriority, CAST(sum(CASE o_orderstatus WHEN 'F' THEN {low} WHEN 'O' THEN {high} ELSE 0 END) AS BIGINT) AS s, CAST(max({low}) AS INTEGER) AS m FROM orders GROUP BY o_orderpriority",
        "function_loop_over_rows": "SELECT c_custkey, CAST(l AS DOUBLE) AS l, CAST(c_nationkey * (c_nationkey + 1) * (c_nationkey + 2) // 6 AS DOUBLE) AS s FROM (SELECT *, CAST(list_sum([CASE WHEN (length(t) - i) % 2 = 0 THEN CAST(t[i] AS INTEGER) WHEN CAST(t[i] AS INTEGER) > 4 THEN 2 * CAST(t[i] AS INTEGER) - 9 ELSE 2 * CAST(t[i] AS INTEGER) END for i in range(1, length(t) + 1)]) % 10 AS INTEGER) AS l FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS t FROM customer)) WHERE l < 7",
        "my_function_over_rows": "SELECT l_returnflag, CAST(sum(CAST(round(CASE WHEN CAST(l_discount AS DECIMAL(4,2)) > 0.05 THEN CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END, 2) AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag",
        "trigger_update_audit": "SELECT o_orderkey AS id, round(o_totalprice, 2) AS was, round(o_totalprice * 2, 2) AS now, 'up' AS what FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0",
        "trigger_all_events": (
            f"WITH m AS ({moved}) SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS DOUBLE) AS was, CAST(NULL AS DOUBLE) AS now, 'out' AS what FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, n_regionkey, n_regionkey + 1, 'moved' FROM nation WHERE n_regionkey <> 2 AND n_nationkey < 6 "
            "UNION ALL SELECT n_nationkey, 0, 0, 'else' FROM m WHERE n_nationkey = 7 UNION ALL SELECT t.n_nationkey, t.n_regionkey, 9, 'moved' FROM m t JOIN m s ON t.n_nationkey = s.n_nationkey + 20 AND s.n_regionkey = 3 "
            "UNION ALL SELECT n_nationkey + 20, NULL, 7, 'in' FROM m WHERE n_regionkey = 3 AND n_nationkey + 20 NOT IN (SELECT n_nationkey FROM m)"
        ),
        "trigger_compound": "SELECT 100 + count(*) AS id, CAST(sum(o_orderkey % 5) AS DOUBLE) AS was, 'sum' AS what FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 100 + count(*), 0, 'sum' FROM orders WHERE o_orderstatus = 'P'",
        "trigger_statement": "SELECT count(*) AS id, CAST(min(c_custkey) AS DOUBLE) AS was, CAST(max(c_custkey) AS DOUBLE) AS now, 'left' AS what FROM customer, (VALUES (1), (2)) t(k) WHERE c_nationkey >= 5 GROUP BY k",
        "block_rollback": "SELECT n_nationkey, n_name || '?' AS n_name, CASE WHEN n_nationkey = 3 THEN 8 ELSE n_regionkey END AS n_regionkey FROM nation",
        "block_savepoints": "SELECT r_regionkey, r_name, (SELECT round(sum(s_acctbal), 2) FROM supplier) AS balance FROM (SELECT * FROM region UNION ALL VALUES (20, 'a'), (22, 'c'))",
        "flashback_as_of": "SELECT o_orderstatus, sum(now) AS now, sum(middle) AS middle, sum(first) AS first FROM (SELECT CASE WHEN o_orderkey < 1000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, 1 AS now, 0 AS middle, 0 AS first FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderstatus, 0, 1, 0 FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderstatus, 0, 0, 1 FROM orders) GROUP BY o_orderstatus",
        "many_inserts": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(100 + i AS INTEGER), 'r' || i FROM range(1, 13) t(i)",
    }
