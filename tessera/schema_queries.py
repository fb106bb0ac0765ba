"""Named queries for schema plans, migration runs, sources, sequences and the stream: each gives rows that SQL can state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialects.nodes import TypeName
from .operators.ranges import key_ranges, plan_ranges
from .operators.sequences import Sequence
from .plans.dag import levels, migration_steps
from .plans.runner import Blocked, Migration
from .schema.plan import plan_schema, refresh
from .schema.types import map_type
from .shared import shared_dir
from .sources.tables import JdbcSource, ParquetSource, dictionary_views

MYSQL = """
CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25) NOT NULL, r_note VARCHAR(10) DEFAULT 'none', r_made TIMESTAMP DEFAULT CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP) COMMENT='parts of the world';
CREATE TABLE nation (n_nationkey INT UNSIGNED NOT NULL AUTO_INCREMENT, n_name VARCHAR(25) NOT NULL COMMENT 'in capitals', n_regionkey INT, n_twice INT GENERATED ALWAYS AS (n_regionkey * 2) VIRTUAL, n_kind ENUM('a','b'), n_doc LONGTEXT CHECK (JSON_VALID(n_doc)),
  PRIMARY KEY (n_nationkey), UNIQUE KEY u_name (n_name), KEY k_region (n_regionkey DESC), FULLTEXT KEY f (n_name), CONSTRAINT ck CHECK (n_regionkey >= 0), FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey) ON DELETE CASCADE)
  PARTITION BY RANGE (n_nationkey) (PARTITION p0 VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN (20), PARTITION p2 VALUES LESS THAN MAXVALUE);
CREATE TABLE nation_like LIKE region;
CREATE VIEW by_region AS SELECT r.r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name;
CREATE VIEW busy AS SELECT r_name FROM by_region WHERE n > 3;
"""

ORACLE = """
CREATE TABLE orders (o_orderkey NUMBER(18) GENERATED BY DEFAULT AS IDENTITY (START WITH 1000), o_custkey NUMBER(9) NOT NULL, o_note VARCHAR2(20 CHAR) DEFAULT ON NULL 'none', o_totalprice NUMBER(12,2),
  CONSTRAINT pk_o PRIMARY KEY (o_orderkey), CONSTRAINT ck CHECK (o_totalprice > 0) ENABLE NOVALIDATE);
CREATE SEQUENCE s START WITH 5 INCREMENT BY 2 MAXVALUE 99 CACHE 20 CYCLE;
CREATE OR REPLACE TYPE addr AS OBJECT (street VARCHAR2(10), no NUMBER(4));
/
CREATE TYPE names AS TABLE OF VARCHAR2(30);
CREATE TABLE people (id NUMBER(9) PRIMARY KEY, home addr, aka names);
CREATE MATERIALIZED VIEW spent BUILD IMMEDIATE AS SELECT o_custkey, ROUND(NVL(SUM(o_totalprice), 0), 2) AS s FROM orders GROUP BY o_custkey;
COMMENT ON TABLE orders IS 'it''s all';
CREATE SYNONYM x FOR orders;
"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _columns(spark, plan) -> DataFrame:
    rows = [(t, i, c.name, c.ddl, c.nullable) for t, p in plan.tables.items() for i, c in enumerate(p.columns)]
    return spark.createDataFrame(rows, "tab string, at int, col string, kind string, may_be_null boolean")


def ddl_columns(spark, d):
    return _columns(spark, plan_schema(MYSQL, "mysql"))


def ddl_user_types(spark, d):
    return _columns(spark, plan_schema(ORACLE, "oracle")).where("tab = 'people'")


def ddl_defaults(spark, d):
    p = plan_schema(MYSQL, "mysql").tables["region"]
    rows = [(c.name, c.default or "", c.on_update_now) for c in p.columns]
    return spark.createDataFrame(rows, "col string, told string, on_update boolean")


def ddl_default_on_null(spark, d):
    p = plan_schema(ORACLE, "oracle").tables["orders"]
    rows = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("o_note"))
    return p.completed(rows)


def ddl_generated(spark, d):
    p = plan_schema(MYSQL, "mysql").tables["nation"]
    return p.completed(_t(spark, d, "nation")).select("n_nationkey", "n_twice")


def ddl_range_chain(spark, d):
    p = plan_schema(MYSQL, "mysql").tables["nation"]
    return p.completed(_t(spark, d, "nation")).groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"))


def ddl_keys(spark, d):
    rows = [(t, k.kind, ",".join(k.columns), k.name) for t, p in plan_schema(MYSQL, "mysql").tables.items() for k in p.keys]
    return spark.createDataFrame(rows, "tab string, kind string, cols string, name string")


def ddl_foreign_keys(spark, d):
    rows = [(t, ",".join(f.columns), f.table[-1], ",".join(f.keys), f.on_delete) for t, p in plan_schema(MYSQL, "mysql").tables.items() for f in p.foreign]
    return spark.createDataFrame(rows, "tab string, cols string, parent string, refs string, on_delete string")


def ddl_violations(spark, d):
    """Rows of the driver's tables that break each rule of the plan."""
    p = plan_schema(MYSQL, "mysql").tables["nation"]
    own = _t(spark, d, "nation").withColumn("n_regionkey", F.expr("CASE n_nationkey WHEN 3 THEN -1 WHEN 4 THEN 77 ELSE n_regionkey END")).withColumn("n_kind", F.expr("IF(n_nationkey > 20, 'z', 'a')"))
    own = own.withColumn("n_name", F.expr("IF(n_nationkey IN (7, 8), 'SAME', n_name)"))
    out = None
    for rule, bad in p.violations(own, {"region": _t(spark, d, "region")}).items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def ddl_constraint_states(spark, d):
    p = plan_schema(ORACLE, "oracle").tables["orders"]
    return spark.createDataFrame([(n, c) for n, c in p.checks], "name string, condition string")


def ddl_like(spark, d):
    return _columns(spark, plan_schema(MYSQL, "mysql")).where("tab = 'nation_like'")


def ddl_alter(spark, d):
    script = "CREATE TABLE a (x INT, y VARCHAR(5)); ALTER TABLE a ADD COLUMN z DECIMAL(12,2) NOT NULL AFTER x, DROP COLUMN y; ALTER TABLE a ADD CONSTRAINT pk PRIMARY KEY (x); ALTER TABLE a MODIFY COLUMN z BIGINT; ALTER TABLE a RENAME COLUMN x TO k;"
    return _columns(spark, plan_schema(script, "mysql"))


def ddl_alter_unknown(spark, d):
    """A change that names an unknown column is reported and does not end the script."""
    plan = plan_schema("CREATE TABLE a (x INT); ALTER TABLE a ADD COLUMN z INT AFTER nothing; CREATE TABLE b (y INT);", "mysql")
    return spark.createDataFrame([(len(plan.tables), sum("not understood" in e.reason for e in plan.report))], "tables int, errors int")


def ddl_drop_rename(spark, d):
    script = "CREATE TABLE a (x INT); CREATE TABLE b (y INT); CREATE VIEW v AS SELECT x FROM a; DROP VIEW v; DROP TABLE IF EXISTS b; RENAME TABLE a TO c; TRUNCATE TABLE c;"
    plan = plan_schema(script, "mysql")
    return spark.createDataFrame([("table", t) for t in plan.tables] + [("view", v) for v in plan.views], "kind string, name string")


def ddl_comments(spark, d):
    p = plan_schema(MYSQL, "mysql").tables
    rows = [(t, "", x.comment) for t, x in p.items() if x.comment] + [(t, c.name, c.comment) for t, x in p.items() for c in x.columns if c.comment]
    return spark.createDataFrame(rows, "tab string, col string, said string")


def ddl_report(spark, d):
    """How many lines of each kind the report of a script has for a table."""
    script = "CREATE TABLE a (x INT PRIMARY KEY); CREATE TRIGGER t AFTER INSERT ON a FOR EACH ROW SET @a = 1; CREATE EVENT e ON SCHEDULE EVERY 1 DAY DO DELETE FROM a; CREATE TABLE b (y INT, FOREIGN KEY (y) REFERENCES gone (z));"
    return plan_schema(script, "mysql").report_frame(spark).where("kind IN ('mapping', 'prerequisite')").select("kind", "object")


def ddl_created_table(spark, d):
    """The plan's CREATE TABLE in the session's catalog, filled and read."""
    name = f"t_{uuid.uuid4().hex[:12]}"
    plan = plan_schema(f"CREATE TABLE {name} (r_regionkey INT NOT NULL, r_name VARCHAR(25), r_flag TINYINT(1) DEFAULT 1)", "mysql")
    spark.sql(plan.tables[name].create_sql())
    _t(spark, d, "region").createOrReplaceTempView("_filled")
    spark.sql(f"INSERT INTO {name} (r_regionkey, r_name) SELECT r_regionkey, r_name FROM _filled")
    return spark.table(name)


def ddl_sequence(spark, d):
    s = plan_schema(ORACLE, "oracle").sequences["s"]
    return spark.createDataFrame([(s["start"], s["step"], s["high"], s["cycle"])], "start_with int, step int, high int, cycles boolean")


def ddl_view(spark, d):
    plan = plan_schema(MYSQL, "mysql")
    for t in ("region", "nation"):
        _t(spark, d, t).createOrReplaceTempView(t)
    for v in ("by_region", "busy"):
        spark.sql(plan.views[v].replace("CREATE OR REPLACE VIEW", "CREATE OR REPLACE TEMPORARY VIEW", 1))
    return spark.table("busy")


def ddl_materialized_view(spark, d):
    plan = plan_schema(ORACLE, "oracle")
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    return refresh(spark, plan, "spent", _folder(spark, "mview"))


def sequence_numbers(spark, d):
    got = Sequence("s", start=10, step=5).numbered(_t(spark, d, "orders").repartition(4), "n")
    return got.agg(F.count("*").alias("n_rows"), F.count_distinct("n").alias("n_numbers"), F.min("n").alias("low"), F.max("n").alias("high"))


def type_mappings(spark, d):
    cases = [("mysql", "TINYINT", ("1",), False), ("mysql", "INT", (), True), ("mysql", "DECIMAL", ("65", "2"), False), ("mysql", "SET", ("a", "b"), False), ("mysql", "DATETIME", ("3",), False), ("oracle", "NUMBER", (), False), ("oracle", "NUMBER", ("9", "0"), False), ("oracle", "DATE", (), False), ("db2", "DECFLOAT", ("34",), False), ("db2", "VARGRAPHIC", ("200",), False)]
    return spark.createDataFrame([(k, n, ",".join(a), map_type(TypeName(n, a, u), k).ddl) for k, n, a, u in cases], "dialect string, name string, args string, kind string")


def _migration(spark, d, **options) -> Migration:
    return Migration(spark, MYSQL.replace("CREATE TABLE nation_like LIKE region;", ""), "mysql", ParquetSource(spark, d), _folder(spark, "migration"), **options)


def run_levels(spark, d):
    m = _migration(spark, d)
    return spark.createDataFrame([(i, s.id) for i, level in enumerate(levels(m.steps)) for s in level], "level int, step string")


def run_without_data(spark, d):
    m = _migration(spark, d)
    return spark.createDataFrame([(s.id,) for s in migration_steps(m.plan, m.script, skip_data=True, create_database=True)], "step string")


def run_migration(spark, d):
    """A whole run over the driver's tables: what each step came to."""
    m = _migration(spark, d)
    m.run("all")
    return spark.createDataFrame(sorted(m.state.status.items()), "step string, status string")


def run_migrated_rows(spark, d):
    m = _migration(spark, d)
    m.run("all")
    return m.table("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "n_regionkey")


def run_progress(spark, d):
    m = _migration(spark, d)
    m.run("all")
    return spark.createDataFrame(sorted(m.progress().items()), "status string, steps int")


def run_replay(spark, d):
    """A replayed copy doubles no rows."""
    m = _migration(spark, d)
    m.run("all")
    m.replay("copy_table:nation")
    waiting = m.progress().get("waiting", 0)
    m.run("all")
    return spark.createDataFrame([(waiting, m.table("nation").count())], "waiting int, n long")


def run_retries(spark, d):
    """A source that fails twice is asked a third time."""
    asked = []
    good = ParquetSource(spark, d)

    def flaky(name):
        asked.append(name)
        if name == "region" and asked.count("region") < 3:
            raise OSError("gone")
        return good(name)

    m = _migration(spark, d, sleep=lambda s: None)
    m.source = flaky
    m.run("all")
    return spark.createDataFrame([(m.state.attempts["copy_table:region"], m.state.status["copy_table:region"])], "attempts int, status string")


def run_gate(spark, d):
    """What blocks a run until it is acknowledged."""
    m = Migration(spark, "CREATE TABLE a (x INT PRIMARY KEY); CREATE TRIGGER t AFTER INSERT ON a FOR EACH ROW SET @a = 1;", "mysql", ParquetSource(spark, d), _folder(spark, "migration"))
    try:
        m.run()
    except Blocked as b:
        return spark.createDataFrame([(e.object,) for e in b.entries], "object string")
    raise AssertionError("the run was not blocked")


def source_ranges(spark, d):
    rows = [(r.index, -1 if r.low is None else int(r.low), -1 if r.high is None else int(r.high)) for r in plan_ranges(_t(spark, d, "supplier"), "s_suppkey", 4)]
    return spark.createDataFrame(rows, "at int, low long, high long").where("at < 2")


def source_range_cap(spark, d):
    return spark.createDataFrame([(len(key_ranges(0, 10**15, 10_000)), len(key_ranges(None, None)))], "ranges int, without_keys int")


def source_bounds(spark, d):
    return _t(spark, d, "orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


def source_sql(spark, d):
    """What is sent to a database: names quoted, keys in ranges, counts, version probes."""
    rows = []
    for kind in ("mysql", "oracle", "db2"):
        s = JdbcSource(spark, kind, "jdbc:none", schema="a`b" if kind == "mysql" else 'a"b')
        rows += [(kind, "count", s.count_sql("t")), (kind, "range", s.range_sql("t", "k")), (kind, "ping", s.ping_sql()), (kind, "first", s.predicates("k", key_ranges(0, 25, 10))[0])]
    return spark.createDataFrame(rows, "dialect string, what string, said string")


def source_urls(spark, d):
    u = JdbcSource.url_for
    rows = [("mysql", u("mysql", "h", 3306, "x")), ("oracle", u("oracle", "h", 1521, "x")), ("sid", u("oracle", "h", 1521, "x", True)), ("db2", u("db2", "h", 50000, "x"))]
    return spark.createDataFrame(rows, "kind string, url string")


def dictionary_columns(spark, d):
    _t(spark, d, "nation").createOrReplaceTempView("dictionary_nation")
    dictionary_views(spark)
    return spark.sql("SELECT column_name, data_type, column_id FROM all_tab_columns WHERE table_name = 'DICTIONARY_NATION'")


def create_database_twice(spark, d):
    name = f"db_{uuid.uuid4().hex[:12]}"
    for _ in range(2):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    return spark.sql("SHOW DATABASES").where(F.col("namespace") == name).agg(F.count("*").alias("n"))


def stream_follow(spark, d):
    """Files followed twice: the second call finds nothing new, and no row is there twice."""
    from .streaming.follow import follow

    into, target, mark = (_folder(spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    events = _t(spark, d, "events")
    events.where("event_id % 2 = 0").write.parquet(into)
    kinds = {"event_id": "bigint", "event_type": "string"}
    follow(spark, into, target, kinds, mark)
    events.where("event_id % 2 = 1").write.mode("append").parquet(into)
    follow(spark, into, target, kinds, mark)
    follow(spark, into, target, kinds, mark)
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))


_ALL = (
    ddl_columns, ddl_user_types, ddl_defaults, ddl_default_on_null, ddl_generated, ddl_range_chain, ddl_keys, ddl_foreign_keys, ddl_violations, ddl_constraint_states, ddl_like, ddl_alter, ddl_alter_unknown, ddl_drop_rename, ddl_comments,
    ddl_report, ddl_created_table, ddl_sequence, ddl_view, ddl_materialized_view, sequence_numbers, type_mappings, run_levels, run_without_data, run_migration, run_migrated_rows, run_progress, run_replay, run_retries, run_gate, source_ranges,
    source_range_cap, source_bounds, source_sql, source_urls, dictionary_columns, create_database_twice, stream_follow,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def _rows(columns: str, *rows: str) -> str:
    """A table of constants; the columns are `name kind` pairs."""
    kinds = [c.strip().split(" ") for c in columns.split(",")]
    cast = ", ".join(f"CAST(c{i} AS {k}) AS {n}" for i, (n, k) in enumerate(kinds))
    return f"SELECT {cast} FROM (VALUES {', '.join(f'({r})' for r in rows)}) v({', '.join(f'c{i}' for i in range(len(kinds)))})"


_REGION = ("0, 'r_regionkey', 'INT', false", "1, 'r_name', 'VARCHAR(25)', false", "2, 'r_note', 'VARCHAR(10)', true", "3, 'r_made', 'TIMESTAMP', true")
_COLUMNS = "tab VARCHAR, at INTEGER, col VARCHAR, kind VARCHAR, may_be_null BOOLEAN"
_STEPS = ("create_table:region", "create_table:nation", "copy_table:region", "copy_table:nation", "check_keys:region", "check_keys:nation", "check_foreign_keys:nation", "create_view:by_region", "create_view:busy", "validate")
_LEVEL = {"create_table": 0, "copy_table": 1, "check_keys": 2, "check_foreign_keys": 3, "create_view": 2, "validate": 3}


def oracle_sql() -> dict[str, str]:
    return {
        "ddl_columns": _rows(
            _COLUMNS, *(f"'region', {r}" for r in _REGION), *(f"'nation_like', {r}" for r in _REGION),
            "'nation', 0, 'n_nationkey', 'BIGINT', false", "'nation', 1, 'n_name', 'VARCHAR(25)', false", "'nation', 2, 'n_regionkey', 'INT', true", "'nation', 3, 'n_twice', 'INT', true", "'nation', 4, 'n_kind', 'STRING', true", "'nation', 5, 'n_doc', 'VARIANT', true",
        ),
        "ddl_user_types": _rows(_COLUMNS, "'people', 0, 'id', 'INT', false", "'people', 1, 'home', 'STRUCT<street: VARCHAR(10), no: SMALLINT>', true", "'people', 2, 'aka', 'ARRAY<VARCHAR(30)>', true"),
        "ddl_defaults": _rows("col VARCHAR, told VARCHAR, on_update BOOLEAN", "'r_regionkey', '', false", "'r_name', '', false", "'r_note', '''none''', false", "'r_made', 'localtimestamp()', true"),
        "ddl_default_on_null": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END AS o_note FROM orders",
        "ddl_generated": "SELECT n_nationkey, n_regionkey * 2 AS n_twice FROM nation",
        "ddl_range_chain": "SELECT CASE WHEN n_nationkey < 10 THEN 'p0' WHEN n_nationkey < 20 THEN 'p1' ELSE 'p2' END AS part, count(*) AS n FROM nation GROUP BY 1",
        "ddl_keys": _rows("tab VARCHAR, kind VARCHAR, cols VARCHAR, name VARCHAR", "'region', 'primary', 'r_regionkey', ''", "'nation', 'primary', 'n_nationkey', ''", "'nation', 'unique', 'n_name', 'u_name'", "'nation', 'index', 'n_regionkey', 'k_region'", "'nation', 'index', 'n_name', 'f'", "'nation_like', 'primary', 'r_regionkey', ''"),
        "ddl_foreign_keys": _rows("tab VARCHAR, cols VARCHAR, parent VARCHAR, refs VARCHAR, on_delete VARCHAR", "'nation', 'n_regionkey', 'region', 'r_regionkey', 'CASCADE'"),
        "ddl_violations": "SELECT 'check ck' AS rule, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'check n_kind', count(*) FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 'unique n_name', CAST(1 AS BIGINT) UNION ALL SELECT 'foreign n_regionkey', CAST(2 AS BIGINT)",
        "ddl_constraint_states": _rows("name VARCHAR, condition VARCHAR", "'ck', '`o_totalprice` > 0'"),
        "ddl_like": _rows(_COLUMNS, *(f"'nation_like', {r}" for r in _REGION)),
        "ddl_alter": _rows(_COLUMNS, "'a', 0, 'k', 'INT', false", "'a', 1, 'z', 'BIGINT', true"),
        "ddl_alter_unknown": "SELECT CAST(2 AS INTEGER) AS tables, CAST(1 AS INTEGER) AS errors",
        "ddl_drop_rename": _rows("kind VARCHAR, name VARCHAR", "'table', 'c'"),
        "ddl_comments": _rows("tab VARCHAR, col VARCHAR, said VARCHAR", "'region', '', 'parts of the world'", "'nation', 'n_name', 'in capitals'", "'nation_like', '', 'parts of the world'"),
        "ddl_report": _rows("kind VARCHAR, object VARCHAR", "'mapping', 'a.x'", "'mapping', 'b.y'", "'prerequisite', 'b'", "'prerequisite', 't'", "'prerequisite', 'e'"),
        "ddl_created_table": "SELECT r_regionkey, r_name, true AS r_flag FROM region",
        "ddl_sequence": _rows("start_with INTEGER, step INTEGER, high INTEGER, cycles BOOLEAN", "5, 2, 99, true"),
        "ddl_view": "SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) > 3",
        "ddl_materialized_view": "SELECT o_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS s FROM orders GROUP BY o_custkey",
        "sequence_numbers": "SELECT count(*) AS n_rows, count(*) AS n_numbers, CAST(10 AS BIGINT) AS low, 10 + 5 * (count(*) - 1) AS high FROM orders",
        "type_mappings": _rows(
            "dialect VARCHAR, name VARCHAR, args VARCHAR, kind VARCHAR", "'mysql', 'TINYINT', '1', 'BOOLEAN'", "'mysql', 'INT', '', 'BIGINT'", "'mysql', 'DECIMAL', '65,2', 'DECIMAL(38,2)'", "'mysql', 'SET', 'a,b', 'ARRAY<STRING>'", "'mysql', 'DATETIME', '3', 'TIMESTAMP_NTZ'",
            "'oracle', 'NUMBER', '', 'DECIMAL(38,10)'", "'oracle', 'NUMBER', '9,0', 'INT'", "'oracle', 'DATE', '', 'TIMESTAMP_NTZ'", "'db2', 'DECFLOAT', '34', 'DECIMAL(38,10)'", "'db2', 'VARGRAPHIC', '200', 'VARCHAR(200)'",
        ),
        "run_levels": _rows("level INTEGER, step VARCHAR", *(f"{3 if s.endswith('busy') else _LEVEL[s.split(':')[0]]}, '{s}'" for s in _STEPS)),
        "run_without_data": _rows("step VARCHAR", "'create_database'", *(f"'{s}'" for s in _STEPS if not s.startswith(("copy", "validate")))),
        "run_migration": _rows("step VARCHAR, status VARCHAR", *(f"'{s}', 'done'" for s in _STEPS)),
        "run_migrated_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "run_progress": _rows("status VARCHAR, steps INTEGER", f"'done', {len(_STEPS)}"),
        "run_replay": "SELECT CAST(6 AS INTEGER) AS waiting, count(*) AS n FROM nation",
        "run_retries": "SELECT CAST(3 AS INTEGER) AS attempts, 'done' AS status",
        "run_gate": "SELECT 't' AS object",
        "source_ranges": _rows("at INTEGER, low BIGINT, high BIGINT", "0, -1, 4", "1, 4, 8"),
        "source_range_cap": "SELECT CAST(10000 AS INTEGER) AS ranges, CAST(1 AS INTEGER) AS without_keys",
        "source_bounds": "SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders",
        "source_sql": _rows(
            "dialect VARCHAR, what VARCHAR, said VARCHAR", "'mysql', 'count', 'SELECT COUNT(*) AS n FROM `a``b`.`t`'", "'mysql', 'range', 'SELECT MIN(`k`) AS a, MAX(`k`) AS b FROM `a``b`.`t`'", "'mysql', 'ping', 'SELECT version()'", "'mysql', 'first', '(`k` < 10) OR `k` IS NULL'",
            "'oracle', 'count', 'SELECT COUNT(*) AS n FROM \"a\"\"b\".\"t\"'", "'oracle', 'range', 'SELECT MIN(\"k\") AS a, MAX(\"k\") AS b FROM \"a\"\"b\".\"t\"'", "'oracle', 'ping', 'SELECT banner FROM v$version WHERE ROWNUM = 1'", "'oracle', 'first', '(\"k\" < 10) OR \"k\" IS NULL'",
            "'db2', 'count', 'SELECT COUNT(*) AS n FROM \"a\"\"b\".\"t\"'", "'db2', 'range', 'SELECT MIN(\"k\") AS a, MAX(\"k\") AS b FROM \"a\"\"b\".\"t\"'", "'db2', 'ping', 'SELECT service_level FROM sysibmadm.env_inst_info'", "'db2', 'first', '(\"k\" < 10) OR \"k\" IS NULL'",
        ),
        "source_urls": _rows("kind VARCHAR, url VARCHAR", "'mysql', 'jdbc:mysql://h:3306/x?zeroDateTimeBehavior=CONVERT_TO_NULL'", "'oracle', 'jdbc:oracle:thin:@//h:1521/x'", "'sid', 'jdbc:oracle:thin:@h:1521:x'", "'db2', 'jdbc:db2://h:50000/x'"),
        "dictionary_columns": _rows("column_name VARCHAR, data_type VARCHAR, column_id INTEGER", "'N_NATIONKEY', 'INT', 1", "'N_NAME', 'STRING', 2", "'N_REGIONKEY', 'INT', 3"),
        "create_database_twice": "SELECT CAST(1 AS BIGINT) AS n",
        "stream_follow": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    }
