"""Named queries over the driver's tables for definitions, catalogs, runs and routine state: what they answer depends on the tables' rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialects import query
from .dialects.routines import Routines
from .plans.runner import Blocked, Migration
from .schema.plan import plan_schema
from .shared import shared_dir
from .sources.introspect import introspect, schemas, script
from .sources.tables import ParquetSource, dictionary_views


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _routines(spark: SparkSession, d: str, *names: str, dialect: str = "oracle") -> Routines:
    for n in names:
        _t(spark, d, n).createOrReplaceTempView(n)
    return Routines(spark, dialect)


# --- definitions over rows ------------------------------------------------------------


def alter_then_fill(spark, d):
    """A table is altered by a script, then filled from another's rows: defaults, a generated column, a renamed and a dropped one, and the rows that break its check."""
    ddl = (
        "CREATE TABLE dealer (s_suppkey BIGINT PRIMARY KEY, s_acctbal DECIMAL(12,2), junk INT); ALTER TABLE dealer DROP COLUMN junk, ADD COLUMN s_nationkey INT NOT NULL AFTER s_suppkey, ADD COLUMN cents BIGINT GENERATED ALWAYS AS (ROUND(s_acctbal * 100)) STORED; "
        "ALTER TABLE dealer RENAME COLUMN s_acctbal TO balance; ALTER TABLE dealer ADD CONSTRAINT solvent CHECK (balance > 0);"
    )
    p = plan_schema(ddl.replace("ROUND(s_acctbal * 100)", "ROUND(balance * 100)"), "mysql").tables["dealer"]
    rows = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("decimal(12,2)").alias("balance"))
    filled = p.completed(rows).select([c.name for c in p.columns])
    broken = p.violations(filled)["check solvent"].count() if "check solvent" in p.violations(filled) else sum(v.count() for k, v in p.violations(filled).items() if "solvent" in k)
    return filled.groupBy("s_nationkey").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n")).withColumn("broken", F.lit(broken).cast("long"))


def rename_drop_then_read(spark, d):
    """What a script leaves after drops and renames is read: each table's rows, and a view over the new name."""
    ddl = "CREATE TABLE nation (n_nationkey INT, n_regionkey INT); CREATE TABLE gone (x INT); CREATE TABLE region (r_regionkey INT, r_name VARCHAR(25)); DROP TABLE gone; RENAME TABLE nation TO country; CREATE VIEW big AS SELECT n_regionkey, COUNT(*) AS n FROM country GROUP BY n_regionkey HAVING COUNT(*) > 4;"
    plan = plan_schema(ddl, "mysql")
    source = {"country": "nation", "region": "region"}
    out = None
    for t, p in plan.tables.items():
        rows = _t(spark, d, source[t]).select([c.name for c in p.columns])
        rows.createOrReplaceTempView(t)
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    for v, text in plan.views.items():
        spark.sql(text.replace("CREATE OR REPLACE VIEW", "CREATE OR REPLACE TEMPORARY VIEW", 1))
        out = out.unionByName(spark.table(v).agg(F.sum("n").alias("n")).select(F.lit(v).alias("name"), "n"))
    return out


def comments_on_columns(spark, d):
    """Comments of a script reach the columns of the rows that are written by it."""
    p = plan_schema("CREATE TABLE part (p_partkey NUMBER(10), p_size NUMBER(5), p_brand VARCHAR2(20)); COMMENT ON COLUMN part.p_size IS 'how large'; COMMENT ON COLUMN part.p_brand IS 'who made it';", "oracle").tables["part"]
    path = _path(spark, "commented")
    rows = _t(spark, d, "part").select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in p.schema().fields])
    rows.write.parquet(path)
    got = spark.read.parquet(path)
    told = [(f.name, f.metadata.get("comment")) for f in got.schema.fields if f.metadata.get("comment")]
    out = None
    for name, said in told:
        one = got.agg(F.count_distinct(name).alias("kinds")).select(F.lit(name).alias("col"), F.lit(said).alias("said"), "kinds")
        out = one if out is None else out.unionByName(one)
    return out


def table_as_select(spark, d):
    """A table that a script makes from a query, read by a view of the same script; a second one declares its columns."""
    for t in ("orders", "customer"):
        _t(spark, d, t).createOrReplaceTempView(t)
    ddl = "CREATE TABLE busy AS SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey; CREATE TABLE named (id BIGINT, who VARCHAR(40)) AS SELECT c_custkey, UPPER(c_name) FROM customer; CREATE VIEW both_of AS SELECT who, n FROM named JOIN busy ON k = id WHERE n > 2;"
    plan = plan_schema(ddl, "mysql")
    for name, p in plan.tables.items():
        p.selected(spark).createOrReplaceTempView(name)
    spark.sql(plan.views["both_of"].replace("CREATE OR REPLACE VIEW", "CREATE OR REPLACE TEMPORARY VIEW", 1))
    return spark.table("both_of")


def object_methods(spark, d):
    """Objects made from columns: attributes, a method with a branch, one that calls for an argument, and one object inside another."""
    _t(spark, d, "customer").createOrReplaceTempView("customer")
    ddl = (
        "CREATE TYPE money AS OBJECT (amount NUMBER(12,2), unit VARCHAR2(3), MEMBER FUNCTION rated RETURN VARCHAR2, MEMBER FUNCTION less(part NUMBER) RETURN NUMBER); / "
        "CREATE TYPE BODY money AS MEMBER FUNCTION rated RETURN VARCHAR2 IS BEGIN IF SELF.amount < 0 THEN RETURN 'owes'; END IF; RETURN unit || '+'; END; MEMBER FUNCTION less(part NUMBER) RETURN NUMBER IS BEGIN RETURN amount - amount * part; END; END; / "
        "CREATE TYPE client AS OBJECT (id NUMBER(10), held money);"
    )
    plan = plan_schema(ddl, "oracle")
    return query(
        spark,
        "SELECT t.c.id AS id, t.c.held.unit AS unit, t.c.held.rated() AS rated, ROUND(CAST(t.c.held.less(0.5) AS BINARY_DOUBLE), 3) AS half FROM (SELECT client(c_custkey, money(c_acctbal, SUBSTR(c_mktsegment, 1, 3))) AS c FROM customer) t WHERE t.c.held.less(0.1) < 5000",
        "oracle",
        objects=plan.objects,
    ).selectExpr("CAST(id AS BIGINT) AS id", "unit", "rated", "half")


# --- catalogs from the tables' own schemas ------------------------------------------------


def _own_catalog(spark: SparkSession, d: str, names: tuple[str, ...]):
    """A MySQL catalog that describes some of the driver's tables by their schemas."""
    kinds = {"bigint": "bigint", "int": "int", "double": "double", "string": "varchar(200)", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime(6)"}
    columns, tables = [], []
    for t in names:
        tables.append(("shop", t, "BASE TABLE"))
        columns += [("shop", t, i + 1, f.name, kinds.get(f.dataType.simpleString(), "text"), "NO" if i == 0 else "YES", None, "", "", "") for i, f in enumerate(_t(spark, d, t).schema.fields)]
    views = {
        "information_schema.schemata": ("schema_name string", [("shop",), ("mysql",), ("information_schema",)]),
        "information_schema.tables": ("table_schema string, table_name string, table_type string", tables),
        "information_schema.columns": ("table_schema string, table_name string, ordinal_position int, column_name string, column_type string, is_nullable string, column_default string, extra string, column_comment string, generation_expression string", columns),
        "information_schema.key_column_usage": ("table_schema string, table_name string, constraint_name string, ordinal_position int, column_name string, referenced_table_name string, referenced_column_name string", [("shop", t, "PRIMARY", 1, next(c[3] for c in columns if c[1] == t), None, None) for t in names]),
        "information_schema.table_constraints": ("table_schema string, table_name string, constraint_name string, constraint_type string", [("shop", t, "PRIMARY", "PRIMARY KEY") for t in names]),
        "information_schema.views": ("table_schema string, table_name string, view_definition string", [("shop", "busy", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 3")]),
        "information_schema.routines": ("routine_schema string, routine_name string, routine_definition string", []),
    }
    return lambda name: spark.createDataFrame(views[name][1], views[name][0])


def introspected_then_copied(spark, d):
    """A catalog made from the tables' schemas is read, planned and run: each table's rows after the copy, and the rows of the view."""
    names = ("nation", "supplier", "orders")
    catalog = _own_catalog(spark, d, names)
    found = [r.name for r in schemas(catalog, "mysql").collect()]
    m = Migration(spark, script(introspect(catalog, "mysql", found[0])), "mysql", ParquetSource(spark, d), _path(spark, "introspected"))
    m.run("all")
    failed = [s for s, v in m.state.status.items() if v != "done"]
    if failed:
        raise AssertionError(f"steps did not end: {failed}")
    out = None
    for t in names:
        one = m.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n", F.lit(len(m.plan.tables[t].columns)).alias("cols"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(spark.table("busy").agg(F.count(F.lit(1)).alias("n")).select(F.lit("busy").alias("name"), "n", F.lit(2).alias("cols")))


def dictionary_indexes(spark, d):
    """Indexes of a script in the dictionary, and how many values their columns hold in the table's rows."""
    plan = plan_schema("CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_brand VARCHAR(20), p_size INT, p_name VARCHAR(60), KEY k_brand (p_brand, p_size), UNIQUE KEY u_name (p_name), FULLTEXT KEY f_name (p_name));", "mysql")
    _t(spark, d, "part").createOrReplaceTempView("part")
    dictionary_views(spark, plan=plan)
    found = query(spark, "SELECT c.index_name AS idx, c.column_name AS col, c.column_position AS pos, i.uniqueness AS uq, i.index_type AS kind FROM user_ind_columns c JOIN dba_indexes i ON c.index_name = i.index_name WHERE c.table_name = 'PART'", "oracle")
    kinds = spark.table("part").agg(*[F.count_distinct(c).alias(c.upper()) for c in ("p_partkey", "p_brand", "p_size", "p_name")])
    kinds = kinds.unpivot([], kinds.columns, "col", "held")
    return found.join(kinds, "col")


def database_twice_then_filled(spark, d):
    """A database that is there is left as it is: what was written between two calls stays."""
    name = f"db_{uuid.uuid4().hex[:12]}"
    m = Migration(spark, "CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25));", "mysql", ParquetSource(spark, d), os.path.join(_path(spark, "twice"), name))
    m.create_database("")
    _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).write.saveAsTable(f"`{name}`.kept")
    m.create_database("")
    return spark.table(f"`{name}`.kept")


def run_after_gate(spark, d):
    """A run that is blocked copies nothing; acknowledged, it copies. Rows of each table before and after, by the level of the copy."""
    ddl = "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25)); CREATE TABLE supplier (s_suppkey BIGINT PRIMARY KEY, s_nationkey INT, FOREIGN KEY (s_nationkey) REFERENCES nation (n_nationkey)); CREATE EVENT e ON SCHEDULE EVERY 1 DAY DO DELETE FROM nation;"
    m = Migration(spark, ddl, "mysql", ParquetSource(spark, d), _path(spark, "gated"))
    blocked = 0
    try:
        m.run()
    except Blocked as b:
        blocked = len(b.entries)
    before = sum(v == "done" for v in m.state.status.values())
    m.run("all")
    out = None
    for t in ("nation", "supplier"):
        one = m.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n", F.lit(blocked).alias("blocked"), F.lit(before).alias("before"))
        out = one if out is None else out.unionByName(one)
    return out


# --- routines whose state comes from rows ------------------------------------------------


def exception_from_rows(spark, d):
    """A condition with a number of its own, raised where a count says so, and told again by the block around it."""
    r = _routines(spark, d, "nation", "customer")
    got = r.run(
        "DECLARE many EXCEPTION; PRAGMA EXCEPTION_INIT(many, -20007); m VARCHAR2(80); BEGIN DECLARE n NUMBER; BEGIN SELECT COUNT(*) INTO n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1); IF n > 2 THEN RAISE_APPLICATION_ERROR(-20007, n || ' customers'); END IF; END; "
        "EXCEPTION WHEN many THEN m := SQLERRM || SQLCODE; END;"
    )
    return spark.createDataFrame([(got["m"],)], "said string")


def package_over_rows(spark, d):
    """A package keeps a total that a cursor loop adds each region's orders to, and a function over rows reads it."""
    r = _routines(spark, d, "nation", "customer", "orders")
    r.create(
        "CREATE PACKAGE p AS total NUMBER := 0; PROCEDURE add(x NUMBER); FUNCTION share(x NUMBER) RETURN NUMBER; END p; / CREATE PACKAGE BODY p AS PROCEDURE add(x NUMBER) IS BEGIN total := total + x; END; FUNCTION share(x NUMBER) RETURN NUMBER IS BEGIN RETURN x / total; END; END p;"
    )
    r.run("BEGIN FOR g IN (SELECT n_regionkey AS k, COUNT(*) AS n FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_regionkey) LOOP p.add(g.n); END LOOP; END;")
    total = r.run("DECLARE a NUMBER; BEGIN a := p.total; END;")["a"]
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select("o_orderstatus", "n", F.lit(int(total)).cast("long").alias("total"))


def collections_over_rows(spark, d):
    """A collection filled from a table: its bounds, an element, and the table's rows beside a constructor's elements."""
    r = _routines(spark, d, "nation")
    got = r.run("DECLARE TYPE t IS TABLE OF VARCHAR2(30); c t; n NUMBER; l NUMBER; e VARCHAR2(30); b NUMBER := 0; BEGIN SELECT n_name BULK COLLECT INTO c FROM nation WHERE n_regionkey = 2 ORDER BY n_name; n := c.COUNT; l := c.LAST; e := c(2); IF c.EXISTS(l) AND NOT c.EXISTS(l + 1) THEN b := 1; END IF; END;")
    rows = query(spark, "SELECT t.column_value AS v, COUNT(*) AS k FROM nation n, TABLE(ODCINUMBERLIST(n.n_nationkey, n.n_regionkey)) t GROUP BY t.column_value", "oracle")
    return rows.select(F.col("v").cast("long").alias("v"), "k").withColumn("n", F.lit(int(got["n"]))).withColumn("last", F.lit(int(got["l"]))).withColumn("second", F.lit(got["e"])).withColumn("there", F.lit(int(got["b"])))


def dual_beside_rows(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    return query(spark, "SELECT (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AS f, (SELECT MAX(o_orderkey) FROM orders) AS top, d.dummy AS x FROM dual d", "oracle")


_ALL = (alter_then_fill, rename_drop_then_read, comments_on_columns, table_as_select, object_methods, introspected_then_copied, dictionary_indexes, database_twice_then_filled, run_after_gate, exception_from_rows, package_over_rows, collections_over_rows, dual_beside_rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    cols = lambda t: f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')"
    return {
        "alter_then_fill": "SELECT s_nationkey, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n, (SELECT count(*) FROM supplier WHERE round(s_acctbal, 2) <= 0) AS broken FROM supplier GROUP BY s_nationkey",
        "rename_drop_then_read": "SELECT 'country' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'big', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 4)",
        "table_as_select": "SELECT upper(c_name) AS who, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE n > 2",
        "object_methods": "SELECT c_custkey AS id, substr(c_mktsegment, 1, 3) AS unit, CASE WHEN b < 0 THEN 'owes' ELSE substr(c_mktsegment, 1, 3) || '+' END AS rated, round(CAST(b AS DOUBLE) * 0.5, 3) AS half FROM (SELECT *, CAST(c_acctbal AS DECIMAL(12, 2)) AS b FROM customer) WHERE b * 0.9 < 5000",
        "comments_on_columns": "SELECT 'p_size' AS col, 'how large' AS said, count(DISTINCT p_size) AS kinds FROM part UNION ALL SELECT 'p_brand', 'who made it', count(DISTINCT p_brand) FROM part",
        "introspected_then_copied": f"SELECT 'nation' AS name, count(*) AS n, CAST({cols('nation')} AS INTEGER) AS cols FROM nation UNION ALL SELECT 'supplier', count(*), CAST({cols('supplier')} AS INTEGER) FROM supplier UNION ALL SELECT 'orders', count(*), CAST({cols('orders')} AS INTEGER) FROM orders UNION ALL SELECT 'busy', count(*), 2 FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 3)",
        "dictionary_indexes": "SELECT idx, col, CAST(pos AS INTEGER) AS pos, uq, kind, CASE col WHEN 'P_PARTKEY' THEN a WHEN 'P_BRAND' THEN b WHEN 'P_SIZE' THEN c ELSE d END AS held FROM (VALUES ('PART_PK', 'P_PARTKEY', 1, 'UNIQUE', 'NORMAL'), ('K_BRAND', 'P_BRAND', 1, 'NONUNIQUE', 'NORMAL'), ('K_BRAND', 'P_SIZE', 2, 'NONUNIQUE', 'NORMAL'), ('U_NAME', 'P_NAME', 1, 'UNIQUE', 'NORMAL'), ('F_NAME', 'P_NAME', 1, 'NONUNIQUE', 'DOMAIN')) t(idx, col, pos, uq, kind), "
        "(SELECT count(DISTINCT p_partkey) AS a, count(DISTINCT p_brand) AS b, count(DISTINCT p_size) AS c, count(DISTINCT p_name) AS d FROM part)",
        "database_twice_then_filled": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
        "run_after_gate": "SELECT 'nation' AS name, count(*) AS n, 1 AS blocked, 0 AS before FROM nation UNION ALL SELECT 'supplier', count(*), 1, 0 FROM supplier",
        "exception_from_rows": "SELECT count(*) || ' customers' || '-20007' AS said FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
        "package_over_rows": "SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS total FROM orders GROUP BY o_orderstatus",
        "collections_over_rows": "SELECT CAST(v AS BIGINT) AS v, count(*) AS k, (SELECT CAST(count(*) AS INTEGER) FROM nation WHERE n_regionkey = 2) AS n, (SELECT CAST(count(*) AS INTEGER) FROM nation WHERE n_regionkey = 2) AS last, (SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name LIMIT 1 OFFSET 1) AS second, 1 AS there FROM (SELECT unnest([n_nationkey, n_regionkey]) AS v FROM nation) GROUP BY v",
        "dual_beside_rows": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_orderkey) AS top, 'X' AS x FROM orders",
    }
