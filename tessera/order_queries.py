"""Named queries for orders and places in them, frames, sequences, hierarchies, routed and limited changes, masks and casts, beside DuckDB's twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialects import query
from .dialects.ddl import ForeignKey
from .operators import actions, dml
from .operators.sequences import Sequence


def _views(spark: SparkSession, d: str, *names: str) -> None:
    for t in names:
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)


def _ask(dialect: str, sql: str, *tables: str):
    def run(spark, d):
        _views(spark, d, *tables)
        return query(spark, sql, dialect)

    return run


_TREE = "(SELECT c_custkey AS id, TRUNC(c_custkey / 10) AS up, c_acctbal AS bal FROM customer WHERE c_custkey > 0) t"
_TREE_TWIN = "t AS (SELECT c_custkey AS id, c_custkey // 10 AS up, c_acctbal AS bal FROM customer WHERE c_custkey > 0)"
_RING = "(SELECT n_nationkey AS id, MOD(n_nationkey * 3 + 1, 25) AS nxt, n_name FROM nation) t"

#: name: (dialect, SQL, tables, twin)
SQL: dict[str, tuple[str, str, tuple[str, ...], str]] = {
    "ora_siblings": (
        "oracle",
        f"SELECT ROWNUM AS n, id, lvl FROM (SELECT id, LEVEL AS lvl FROM {_TREE} START WITH up = 0 CONNECT BY PRIOR id = up ORDER SIBLINGS BY bal DESC, id)",
        ("customer",),
        f"WITH RECURSIVE {_TREE_TWIN}, s AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY bal DESC, id) AS place FROM t), r AS (SELECT id, 1 AS lvl, [place] AS path FROM s WHERE up = 0 UNION ALL SELECT s.id, r.lvl + 1, list_append(r.path, s.place) FROM r JOIN s ON s.up = r.id) SELECT row_number() OVER (ORDER BY path) AS n, id, lvl FROM r",
    ),
    "ora_connect_by_isleaf": (
        "oracle",
        f"SELECT id, LEVEL AS lvl, CONNECT_BY_ISLEAF AS leaf FROM {_TREE} START WITH up = 0 CONNECT BY PRIOR id = up AND bal > 0",
        ("customer",),
        f"WITH RECURSIVE {_TREE_TWIN}, r AS (SELECT id, 1 AS lvl FROM t WHERE up = 0 UNION ALL SELECT t.id, r.lvl + 1 FROM r JOIN t ON t.up = r.id AND t.bal > 0) SELECT id, lvl, CAST(id NOT IN (SELECT up FROM t WHERE bal > 0) AS INTEGER) AS leaf FROM r",
    ),
    "ora_connect_by_iscycle": (
        "oracle",
        f"SELECT id, LEVEL AS lvl, CONNECT_BY_ISCYCLE AS cyc, CONNECT_BY_ISLEAF AS leaf FROM {_RING} START WITH id < 4 CONNECT BY NOCYCLE PRIOR nxt = id",
        ("nation",),
        "WITH RECURSIVE t AS (SELECT n_nationkey AS id, (n_nationkey * 3 + 1) % 25 AS nxt FROM nation), r AS (SELECT id, nxt, 1 AS lvl, [id] AS way FROM t WHERE id < 4 UNION ALL SELECT t.id, t.nxt, r.lvl + 1, list_append(r.way, t.id) FROM r JOIN t ON r.nxt = t.id WHERE NOT list_contains(r.way, t.id)) "
        "SELECT id, lvl, CAST(list_contains(way, nxt) AS INTEGER) AS cyc, CAST(list_contains(way, nxt) AS INTEGER) AS leaf FROM r",
    ),
    "ora_fetch_percent": (
        "oracle",
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber OFFSET 7 ROWS FETCH NEXT 2.5 PERCENT ROWS ONLY",
        ("lineitem",),
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS p, count(*) OVER () AS c FROM lineitem) WHERE p > 7 AND p <= 7 + ceil(c * 2.5 / 100)",
    ),
    "ora_rownum_list": (
        "oracle",
        "SELECT COUNT(*) AS n, COUNT(DISTINCT k) AS d, MIN(k) AS low, MAX(k) AS high FROM (SELECT o_orderkey, ROWNUM AS k FROM orders WHERE o_orderstatus = 'F')",
        ("orders",),
        "SELECT count(*) AS n, count(*) AS d, CAST(1 AS BIGINT) AS low, count(*) AS high FROM orders WHERE o_orderstatus = 'F'",
    ),
    "win_groups_frame": (
        "oracle",
        "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, COUNT(*) OVER (ORDER BY o_orderpriority, o_orderstatus GROUPS 1 PRECEDING) AS n FROM orders",
        ("orders",),
        "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (ORDER BY o_orderpriority, o_orderstatus GROUPS 1 PRECEDING) AS n FROM orders",
    ),
    "win_exclude_row": (
        "oracle",
        "SELECT o_orderkey, MAX(o_custkey) OVER w AS m, COUNT(o_custkey) OVER w AS n, AVG(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS a FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)",
        ("orders",),
        "SELECT o_orderkey, max(o_custkey) OVER w AS m, count(o_custkey) OVER w AS n, avg(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS a FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)",
    ),
    "win_exclude_groups": (
        "oracle",
        "SELECT c_custkey, SUM(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS g, MIN(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS t, "
        "COUNT(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS r FROM customer",
        ("customer",),
        "SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS g, min(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS t, "
        "count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS r FROM customer",
    ),
    "ora_to_char_numbers": (
        "oracle",
        "SELECT s_suppkey, TO_CHAR(s_acctbal, '99,990.99') AS a, TO_CHAR(s_acctbal, 'FM$99990.00') AS b, TO_CHAR(s_suppkey, '0000') AS c, TO_CHAR(s_acctbal, '9999') AS d, TO_CHAR(ROUND(s_acctbal), 'S99999') AS e FROM supplier",
        ("supplier",),
        "SELECT s_suppkey, lpad((CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END) || regexp_replace(split_part(t, '.', 1), '^(.+)(...)$', '\\1,\\2') || '.' || split_part(t, '.', 2), 10, ' ') AS a, (CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END) || '$' || t AS b, ' ' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS c, "
        "CASE WHEN length(w) > 4 THEN '#####' ELSE lpad((CASE WHEN s_acctbal < 0 AND w <> '0' THEN '-' ELSE '' END) || w, 5, ' ') END AS d, lpad((CASE WHEN s_acctbal < 0 AND w <> '0' THEN '-' ELSE '+' END) || w, 6, ' ') AS e "
        "FROM (SELECT *, CAST(CAST(round(abs(s_acctbal), 2) AS DECIMAL(12, 2)) AS VARCHAR) AS t, CAST(CAST(round(abs(s_acctbal)) AS BIGINT) AS VARCHAR) AS w FROM supplier)",
    ),
    "my_bad_casts": (
        "mysql",
        "SELECT n_nationkey, CAST(SUBSTR(n_name, 1, 3) AS SIGNED) AS a, CAST(CONCAT(n_nationkey, '.9') AS SIGNED) AS b, CONCAT(n_nationkey, 'x') + 1 AS c, CONCAT(n_nationkey, '') + 1 AS d, CAST(n_nationkey + 0.5 AS SIGNED) AS e FROM nation",
        ("nation",),
        "SELECT n_nationkey, CAST(NULL AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS c, CAST(n_nationkey + 1 AS DOUBLE) AS d, CAST(n_nationkey + 1 AS BIGINT) AS e FROM nation",
    ),
    "ora_initcap": (
        "oracle",
        "SELECT p_partkey, INITCAP(p_name || '-' || p_type || '_' || p_partkey || 'th') AS t FROM part",
        ("part",),
        r"SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all(p_name || '-' || p_type || '_' || p_partkey || 'th', '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')], '') AS t FROM part",
    ),
}


def ora_nextval(spark, d):
    """Numbers of a sequence for every row, in arithmetic and beside CURRVAL; a second query goes on behind them."""
    _views(spark, d, "orders")
    seq = {"sq": Sequence("sq", 100, 5)}
    first = query(spark, "SELECT o_orderkey, sq.NEXTVAL AS k, sq.CURRVAL * 2 AS twice FROM orders WHERE o_orderstatus = 'P'", "oracle", sequences=seq)
    more = query(spark, "SELECT sq.NEXTVAL AS k FROM orders WHERE o_orderstatus = 'F'", "oracle", sequences=seq)
    told = lambda df, name: df.agg(F.count("k").alias("n"), F.count_distinct("k").alias("d"), F.min("k").alias("low"), F.max("k").alias("high")).withColumn("part", F.lit(name))
    return told(first.where("twice = 2 * k"), "first").unionByName(told(more, "more"))


def _routed(spark, d, sql: str) -> DataFrame:
    _views(spark, d, "orders")
    for t in ("big", "late", "rest"):
        spark.createDataFrame([], "k bigint, what string").createOrReplaceTempView(t)
    got = dml.insert_all(spark, sql)
    out = None
    for t, c in got.items():
        rows = c.table.withColumn("target", F.lit(t))
        out = rows if out is None else out.unionByName(rows)
    return out


def ora_insert_all(spark, d):
    return _routed(
        spark,
        d,
        "INSERT ALL WHEN o_totalprice > 100000 THEN INTO big VALUES (o_orderkey, 'p' || o_orderstatus) INTO rest (k) VALUES (-o_orderkey) WHEN o_orderdate >= DATE '1996-01-01' THEN INTO late (what, k) VALUES (o_orderpriority, o_orderkey) ELSE INTO rest VALUES (o_orderkey, 'else') SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate, o_orderpriority FROM orders",
    )


def ora_insert_first(spark, d):
    return _routed(
        spark,
        d,
        "INSERT FIRST WHEN p > 100000 THEN INTO big VALUES (o_orderkey, 'b') WHEN o_orderdate >= DATE '1996-01-01' THEN INTO late VALUES (o_orderkey, 'l') ELSE INTO rest VALUES (o_orderkey, NULL) SELECT o_orderkey, o_totalprice AS p, o_orderdate FROM orders",
    )


def my_delete_limit(spark, d):
    _views(spark, d, "orders")
    return dml.execute(spark, "DELETE FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "mysql").table.select("o_orderkey")


def my_update_limit(spark, d):
    _views(spark, d, "nation")
    return dml.execute(spark, "UPDATE nation SET n_name = CONCAT(n_name, '!'), n_regionkey = 9 WHERE n_regionkey < 4 ORDER BY n_name LIMIT 6", "mysql").table.select("n_nationkey", "n_name", "n_regionkey")


def my_delete_two_tables(spark, d):
    _views(spark, d, "customer", "orders")
    got = dml.deletes(spark, "DELETE c, o FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 3 AND o.o_orderstatus = 'F'", "mysql")
    return got["customer"].table.selectExpr("'c' AS t", "c_custkey AS k").unionByName(got["orders"].table.selectExpr("'o' AS t", "o_orderkey AS k"))


def fk_delete_actions(spark, d):
    """A region goes: nations by CASCADE, their customers by CASCADE, these customers' orders lose their customer, and suppliers lose their nation."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    tables = {t: read(t) for t in ("region", "nation", "customer", "supplier")} | {"orders": read("orders").select("o_orderkey", "o_custkey")}
    foreign = {
        "nation": [ForeignKey(["n_regionkey"], ("region",), ["r_regionkey"], on_delete="CASCADE")],
        "customer": [ForeignKey(["c_nationkey"], ("nation",), ["n_nationkey"], on_delete="CASCADE")],
        "supplier": [ForeignKey(["s_nationkey"], ("nation",), ["n_nationkey"], on_delete="SET NULL")],
        "orders": [ForeignKey(["o_custkey"], ("customer",), ["c_custkey"], on_delete="SET NULL")],
    }
    left = actions.delete_with_actions(tables, foreign, "region", "r_regionkey = 2")
    counts = [left[t].select(F.lit(t).alias("t"), F.lit(None).cast("long").alias("k")) for t in ("region", "nation", "customer")]
    counts += [left["orders"].selectExpr("'orders' AS t", "CAST(o_custkey AS BIGINT) AS k"), left["supplier"].selectExpr("'supplier' AS t", "CAST(s_nationkey AS BIGINT) AS k")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("whole"))


_FUNCTIONS = (ora_nextval, ora_insert_all, ora_insert_first, my_delete_limit, my_update_limit, my_delete_two_tables, fk_delete_actions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _ask(dialect, sql, *tables) for name, (dialect, sql, tables, _) in SQL.items()} | {f.__name__: f for f in _FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    big, late = "o_totalprice > 100000", "o_orderdate >= DATE '1996-01-01'"
    gone = "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"
    return {name: twin for name, (_, _, _, twin) in SQL.items()} | {
        "ora_nextval": "WITH c AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders) SELECT 'first' AS part, p AS n, p AS d, CAST(100 AS BIGINT) AS low, 100 + 5 * (p - 1) AS high FROM c UNION ALL SELECT 'more', f, f, 100 + 5 * p, 100 + 5 * (p + f - 1) FROM c",
        "ora_insert_all": f"SELECT o_orderkey AS k, 'p' || o_orderstatus AS what, 'big' AS target FROM orders WHERE {big} UNION ALL SELECT -o_orderkey, NULL, 'rest' FROM orders WHERE {big} UNION ALL SELECT o_orderkey, o_orderpriority, 'late' FROM orders WHERE {late} UNION ALL SELECT o_orderkey, 'else', 'rest' FROM orders WHERE NOT ({big}) AND NOT ({late})",
        "ora_insert_first": f"SELECT o_orderkey AS k, CASE WHEN {big} THEN 'b' WHEN {late} THEN 'l' END AS what, CASE WHEN {big} THEN 'big' WHEN {late} THEN 'late' ELSE 'rest' END AS target FROM orders",
        "my_delete_limit": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)",
        "my_update_limit": "SELECT n_nationkey, CASE WHEN hit THEN n_name || '!' ELSE n_name END AS n_name, CASE WHEN hit THEN 9 ELSE n_regionkey END AS n_regionkey FROM (SELECT *, n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4 ORDER BY n_name LIMIT 6) AS hit FROM nation)",
        "my_delete_two_tables": "WITH j AS (SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderstatus = 'F') SELECT 'c' AS t, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM j) UNION ALL SELECT 'o', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM j)",
        "fk_delete_actions": f"SELECT 'region' AS t, count(*) AS n, CAST(0 AS BIGINT) AS whole FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'nation', count(*), 0 FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'customer', count(*), 0 FROM customer WHERE c_custkey NOT IN ({gone}) "
        f"UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o_custkey NOT IN ({gone})) FROM orders UNION ALL SELECT 'supplier', count(*), count(*) FILTER (WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)) FROM supplier",
    }
