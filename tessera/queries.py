"""Named queries over the driver's tables: source SQL in a dialect, run through the translator, beside DuckDB's twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dialect_queries
from .dialects import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: name: (dialect, SQL of the dialect, SQL of DuckDB)
SQL: dict[str, tuple[str, str, str]] = {
    # joins
    "ora_plus_left": (
        "oracle",
        "SELECT c.c_mktsegment, NVL(ROUND(SUM(o.o_totalprice), 2), 0) AS revenue, DECODE(c.c_mktsegment, 'BUILDING', 'B', 'OTHER') AS tag FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND o.o_orderstatus(+) = 'F' GROUP BY c.c_mktsegment",
        "SELECT c.c_mktsegment, coalesce(round(sum(o.o_totalprice), 2), 0) AS revenue, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'B' ELSE 'OTHER' END AS tag FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_mktsegment",
    ),
    "ora_plus_filter_in_on": (
        "oracle",
        "SELECT n.n_name, COUNT(s.s_suppkey) AS n FROM nation n, supplier s WHERE n.n_nationkey = s.s_nationkey(+) AND s.s_acctbal(+) > 5000 GROUP BY n.n_name",
        "SELECT n.n_name, count(s.s_suppkey) AS n FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name",
    ),
    "ora_plus_two_tables": (
        "oracle",
        "SELECT r.r_name, COUNT(n.n_nationkey) AS nations, COUNT(s.s_suppkey) AS suppliers FROM region r, nation n, supplier s WHERE r.r_regionkey = n.n_regionkey(+) AND n.n_nationkey = s.s_nationkey(+) GROUP BY r.r_name",
        "SELECT r.r_name, count(n.n_nationkey) AS nations, count(s.s_suppkey) AS suppliers FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey GROUP BY r.r_name",
    ),
    "ora_plus_residual_where": (
        "oracle",
        "SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND c.c_nationkey = 3 AND o.o_orderkey IS NULL",
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 3 AND o.o_orderkey IS NULL",
    ),
    "my_bare_join_cross": ("mysql", "SELECT r.r_name, n.n_name FROM region r JOIN nation n", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n"),
    "my_straight_join": (
        "mysql",
        "SELECT STRAIGHT_JOIN n.n_name, COUNT(*) AS n FROM nation n STRAIGHT_JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
        "SELECT n.n_name, count(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    ),
    "join_using_full": (
        "mysql",
        "SELECT k, a.x, b.y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) b USING (k)",
        "SELECT k, a.x, b.y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) b USING (k)",
    ),
    "join_natural": (
        "oracle",
        "SELECT r_name, COUNT(*) AS n FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k FROM nation) b GROUP BY r_name",
        "SELECT r_name, count(*) AS n FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k FROM nation) b GROUP BY r_name",
    ),
    "join_theta": (
        "mysql",
        "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "join_lateral_topn": (
        "mysql",
        "SELECT n.n_name, t.c_name, t.c_acctbal FROM nation n, LATERAL (SELECT c_name, c_acctbal FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t",
        "SELECT n.n_name, t.c_name, t.c_acctbal FROM nation n, LATERAL (SELECT c_name, c_acctbal FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t",
    ),
    "comma_cross": ("oracle", "SELECT r.r_name, p.p_brand FROM region r, (SELECT DISTINCT p_brand FROM part) p", "SELECT r.r_name, p.p_brand FROM region r, (SELECT DISTINCT p_brand FROM part) p"),
    "join_right": (
        "mysql",
        "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000",
        "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000",
    ),
    # subqueries
    "exists_corr": (
        "oracle",
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    ),
    "not_exists": (
        "mysql",
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    ),
    "in_sub": (
        "db2",
        "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
        "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    ),
    "not_in_nulls": (
        "oracle",
        "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT DECODE(r_regionkey, 0, NULL, r_regionkey) FROM region)",
        "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region)",
    ),
    "scalar_sub": (
        "mysql",
        "SELECT c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
        "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    ),
    "derived_alias_cols": (
        "mysql",
        "SELECT t.seg, t.n FROM (SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment) AS t (seg, n)",
        "SELECT t.seg, t.n FROM (SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment) AS t (seg, n)",
    ),
    "cte_chain": (
        "mysql",
        "WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE s > 1000000) SELECT c.c_mktsegment, COUNT(*) AS n FROM customer c JOIN b ON b.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
        "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE s > 1000000) SELECT c.c_mktsegment, count(*) AS n FROM customer c JOIN b ON b.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    ),
    "cte_recursive": (
        "mysql",
        "WITH RECURSIVE t (n, f) AS (SELECT 1, CAST(1 AS SIGNED) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
        "WITH RECURSIVE t (n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
    ),
    "ora_connect_by": (
        "oracle",
        "SELECT n_nationkey, LEVEL AS depth FROM nation START WITH n_nationkey = 0 CONNECT BY PRIOR n_nationkey = n_regionkey AND n_nationkey > n_regionkey",
        "WITH RECURSIVE t AS (SELECT n_nationkey, 1 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM t JOIN nation n ON n.n_regionkey = t.n_nationkey AND n.n_nationkey > n.n_regionkey) SELECT n_nationkey, depth FROM t",
    ),
    "ora_connect_by_level": ("oracle", "SELECT LEVEL AS n, LEVEL * LEVEL AS sq FROM dual CONNECT BY LEVEL <= 20", "SELECT CAST(i AS INTEGER) AS n, CAST(i * i AS INTEGER) AS sq FROM range(1, 21) t(i)"),
    # aggregation
    "group_having": (
        "mysql",
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 6) AS disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    ),
    "count_distinct": ("oracle", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus"),
    "my_group_concat_sep": (
        "mysql",
        "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '; ') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    ),
    "ora_listagg": (
        "oracle",
        "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    ),
    "ora_percentile_cont": (
        "oracle",
        "SELECT c_mktsegment, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS mid FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS mid FROM customer GROUP BY c_mktsegment",
    ),
    "ora_nested_agg": (
        "oracle",
        "SELECT MAX(COUNT(*)) AS most, MIN(COUNT(*)) AS least FROM orders GROUP BY o_custkey",
        "SELECT max(n) AS most, min(n) AS least FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    ),
    "ora_rollup": (
        "oracle",
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)",
    ),
    "ora_cube": (
        "oracle",
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)",
    ),
    "ora_grouping_sets": (
        "oracle",
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    ),
    "my_with_rollup": (
        "mysql",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP",
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    ),
    "my_loose_group": (
        "mysql",
        "SELECT n.n_nationkey, n.n_name, COUNT(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey",
        "SELECT n.n_nationkey, any_value(n.n_name) AS n_name, count(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey",
    ),
    # windows
    "win_rank_family": (
        "oracle",
        "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer",
        "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS dr, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS q FROM customer",
    ),
    "win_lag_lead": (
        "mysql",
        "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, LEAD(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders",
        "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders",
    ),
    "win_rows_frame": (
        "oracle",
        "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
        "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    ),
    "win_range_frame": (
        "oracle",
        "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part",
        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part",
    ),
    "win_named": (
        "mysql",
        "SELECT s_suppkey, SUM(s_suppkey) OVER w AS s, COUNT(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)",
        "SELECT s_suppkey, CAST(sum(s_suppkey) OVER w AS BIGINT) AS s, count(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)",
    ),
    "win_first_last_nth": (
        "oracle",
        "SELECT n_nationkey, FIRST_VALUE(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f, LAST_VALUE(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(n_name, 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM nation",
        "SELECT n_nationkey, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(n_name, 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM nation",
    ),
    "win_pct": (
        "oracle",
        "SELECT n_nationkey, ROUND(PERCENT_RANK() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 6) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 6) AS cd FROM nation",
        "SELECT n_nationkey, round(percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 6) AS cd FROM nation",
    ),
    "ora_rownum_projection": (
        "oracle",
        "SELECT COUNT(*) AS n, MAX(q.rn) AS most FROM (SELECT n_name, ROWNUM AS rn FROM nation WHERE n_regionkey = 1) q",
        "SELECT count(*) AS n, CAST(max(rn) AS INTEGER) AS most FROM (SELECT n_name, row_number() OVER () AS rn FROM nation WHERE n_regionkey = 1) q",
    ),
    # order and limit
    "ora_rownum_le": (
        "oracle",
        "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) WHERE ROWNUM <= 10",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "ora_rownum_lt": (
        "oracle",
        "SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC) q WHERE 5 > ROWNUM",
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 4",
    ),
    "ora_rownum_before_order": ("oracle", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders WHERE ROWNUM <= 7 ORDER BY o_orderkey DESC) q", "SELECT CAST(7 AS BIGINT) AS n"),
    "ora_rownum_eq_two": ("oracle", "SELECT n_name FROM nation WHERE ROWNUM = 2", "SELECT n_name FROM nation WHERE false"),
    "ora_offset_fetch": (
        "oracle",
        "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey OFFSET 5 ROWS FETCH NEXT 10 ROWS ONLY",
        "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5",
    ),
    "ora_fetch_with_ties": (
        "oracle",
        "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC FETCH FIRST 10 ROWS WITH TIES",
        "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10",
    ),
    "ora_fetch_percent": (
        "oracle",
        "SELECT p_partkey FROM part ORDER BY p_partkey FETCH FIRST 5 PERCENT ROWS ONLY",
        "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS n FROM part) WHERE r <= ceil(n * 5 / 100.0)",
    ),
    "my_limit_comma": ("mysql", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 3, 7", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7 OFFSET 3"),
    "db2_fetch_first": ("db2", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey FETCH FIRST 4 ROWS ONLY WITH UR", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 4"),
    "order_nulls_ora": (
        "oracle",
        "SELECT k, x FROM (SELECT n_nationkey AS k, NULLIF(n_regionkey, 2) AS x FROM nation) ORDER BY x DESC, k FETCH FIRST 6 ROWS ONLY",
        "SELECT k, x FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS x FROM nation) ORDER BY x DESC NULLS FIRST, k LIMIT 6",
    ),
    "order_nulls_my": (
        "mysql",
        "SELECT k, x FROM (SELECT n_nationkey AS k, NULLIF(n_regionkey, 2) AS x FROM nation) q ORDER BY x, k LIMIT 6",
        "SELECT k, x FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS x FROM nation) ORDER BY x NULLS FIRST, k LIMIT 6",
    ),
    # set operations
    "union_all": ("mysql", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region"),
    "union_distinct": ("mysql", "SELECT n_regionkey AS x FROM nation UNION DISTINCT SELECT r_regionkey FROM region ORDER BY x LIMIT 4", "SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey FROM region ORDER BY x LIMIT 4"),
    "ora_minus": ("oracle", "SELECT c_nationkey AS k FROM customer MINUS SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier"),
    "intersect_chain": (
        "oracle",
        "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier",
        "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier",
    ),
    "except_all": ("mysql", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    # predicates and functions
    "nullsafe_eq": ("mysql", "SELECT n_nationkey FROM nation WHERE NULLIF(n_regionkey, 1) <=> NULL", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 1) IS NOT DISTINCT FROM NULL"),
    "like_escape": ("oracle", "SELECT n_name FROM nation WHERE n_name || '_x' LIKE '%!_x' ESCAPE '!' AND n_name NOT LIKE 'A%'", "SELECT n_name FROM nation WHERE n_name || '_x' LIKE '%!_x' ESCAPE '!' AND n_name NOT LIKE 'A%'"),
    "between_in": ("mysql", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT IN (12, 15)", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT IN (12, 15)"),
    "case_forms": (
        "db2",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o_totalprice > 100000 THEN 'big' END AS b FROM orders",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o_totalprice > 100000 THEN 'big' END AS b FROM orders",
    ),
    "my_div_mod": (
        "mysql",
        "SELECT n_nationkey, n_nationkey DIV 4 AS d, n_nationkey MOD 4 AS m, n_nationkey DIV 0 AS z, ROUND(n_nationkey / 4, 4) AS q FROM nation",
        "SELECT n_nationkey, CAST(n_nationkey // 4 AS BIGINT) AS d, n_nationkey % 4 AS m, CAST(NULL AS BIGINT) AS z, round(n_nationkey / 4.0, 4) AS q FROM nation",
    ),
    "db2_int_division": ("db2", "SELECT n_nationkey, n_nationkey / 4 AS d FROM nation", "SELECT n_nationkey, CAST(n_nationkey // 4 AS BIGINT) AS d FROM nation"),
    "my_or_pipes": ("mysql", "SELECT n_name FROM nation WHERE n_nationkey = 3 || n_nationkey = 5 && n_regionkey > 1", "SELECT n_name FROM nation WHERE n_nationkey = 3 OR (n_nationkey = 5 AND n_regionkey > 1)"),
    "ora_concat_null": ("oracle", "SELECT n_nationkey, n_name || NULLIF(n_regionkey, 1) || '.' AS x FROM nation", "SELECT n_nationkey, n_name || coalesce(CAST(nullif(n_regionkey, 1) AS VARCHAR), '') || '.' AS x FROM nation"),
    "ora_nvl_nvl2": (
        "oracle",
        "SELECT n_nationkey, NVL(NULLIF(n_regionkey, 1), -1) AS a, NVL2(NULLIF(n_regionkey, 1), 'y', 'n') AS b FROM nation",
        "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS a, CASE WHEN nullif(n_regionkey, 1) IS NOT NULL THEN 'y' ELSE 'n' END AS b FROM nation",
    ),
    "ora_decode_null": (
        "oracle",
        "SELECT n_nationkey, DECODE(NULLIF(n_regionkey, 1), NULL, 'none', 2, 'two', 'other') AS x FROM nation",
        "SELECT n_nationkey, CASE WHEN nullif(n_regionkey, 1) IS NULL THEN 'none' WHEN n_regionkey = 2 THEN 'two' ELSE 'other' END AS x FROM nation",
    ),
    "db2_value": ("db2", "SELECT n_nationkey, VALUE(NULLIF(n_regionkey, 1), 99) AS x FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), 99) AS x FROM nation"),
    "greatest_nulls": ("mysql", "SELECT n_nationkey, GREATEST(n_nationkey, NULLIF(n_regionkey, 1)) AS g FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE greatest(n_nationkey, n_regionkey) END AS g FROM nation"),
    "ora_trunc_date_masks": (
        "oracle",
        "SELECT o_orderkey, TRUNC(o_orderdate, 'YYYY') AS y, TRUNC(o_orderdate, 'Q') AS q, TRUNC(o_orderdate, 'MM') AS m, TRUNC(o_orderdate, 'IW') AS w, TRUNC(o_orderdate) AS d FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS y, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d FROM orders",
    ),
    "ora_trunc_number": ("oracle", "SELECT c_custkey, ROUND(TRUNC(c_acctbal, 1), 1) AS t FROM customer", "SELECT c_custkey, round(trunc(c_acctbal * 10) / 10, 1) AS t FROM customer"),
    "ora_to_char_masks": (
        "oracle",
        "SELECT o_orderkey, TO_CHAR(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS t, TO_CHAR(o_orderdate, 'DD/MM/YY') AS d, TO_CHAR(o_orderkey) AS k FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, strftime(o_orderdate, '%d/%m/%y') AS d, CAST(o_orderkey AS VARCHAR) AS k FROM orders",
    ),
    "ora_to_date": ("oracle", "SELECT TO_DATE('31-12-1999 23:05', 'DD-MM-YYYY HH24:MI') AS d, DATE '2020-02-29' AS e FROM dual", "SELECT TIMESTAMP '1999-12-31 23:05:00' AS d, TIMESTAMP '2020-02-29 00:00:00' AS e"),
    "ora_date_arith": (
        "oracle",
        "SELECT o_orderkey, o_orderdate + 1.5 AS a, o_orderdate - 7 AS b, ROUND(o_orderdate - DATE '1995-01-01', 6) AS c FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR AS a, o_orderdate - INTERVAL 7 DAY AS b, round(epoch(o_orderdate - TIMESTAMP '1995-01-01 00:00:00') / 86400.0, 6) AS c FROM orders",
    ),
    "my_date_format": ("mysql", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m/%d %H:%i') AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS t FROM orders"),
    "my_str_to_date": ("mysql", "SELECT STR_TO_DATE('17.03.2001', '%d.%m.%Y') AS d, STR_TO_DATE('x', '%Y') AS bad", "SELECT TIMESTAMP '2001-03-17 00:00:00' AS d, CAST(NULL AS TIMESTAMP) AS bad"),
    "my_interval_arith": (
        "mysql",
        "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 1 QUARTER) AS a, o_orderdate - INTERVAL 2 WEEK AS b, DATEDIFF(o_orderdate, '1995-01-01') AS c FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS a, o_orderdate - INTERVAL 14 DAY AS b, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS c FROM orders",
    ),
    "ora_add_months": (
        "oracle",
        "SELECT o_orderkey, ADD_MONTHS(o_orderdate, 1) AS a FROM orders WHERE EXTRACT(DAY FROM o_orderdate) < 28",
        "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a FROM orders WHERE extract(day FROM o_orderdate) < 28",
    ),
    "my_elt_field": (
        "mysql",
        "SELECT n_nationkey, ELT(n_regionkey, 'a', 'b', 'c') AS e, CAST(FIELD(n_regionkey, 3, 1) AS SIGNED) AS f FROM nation",
        "SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS e, CAST(CASE n_regionkey WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS f FROM nation",
    ),
    "my_if_strings": (
        "mysql",
        "SELECT n_nationkey, IF(n_regionkey > 2, UCASE(n_name), LCASE(n_name)) AS a, CHAR_LENGTH(n_name) AS b, CONCAT(n_name, NULL) AS c, LOCATE('A', n_name, 2) AS d, SUBSTRING(n_name FROM 2 FOR 3) AS e FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN upper(n_name) ELSE lower(n_name) END AS a, CAST(length(n_name) AS INTEGER) AS b, CAST(NULL AS VARCHAR) AS c, CAST(CASE WHEN instr(n_name[2:], 'A') = 0 THEN 0 ELSE instr(n_name[2:], 'A') + 1 END AS INTEGER) AS d, substr(n_name, 2, 3) AS e FROM nation",
    ),
    "my_json_extract": (
        "mysql",
        "SELECT event_id, JSON_UNQUOTE(JSON_EXTRACT(props, '$.k')) AS k, props->>'$.k' AS j, JSON_VALID(props) AS v FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS j, json_valid(props) AS v FROM events",
    ),
    "ora_json_value": ("oracle", "SELECT event_id, JSON_VALUE(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "db2_locate_posstr": (
        "db2",
        "SELECT n_nationkey, LOCATE('A', n_name) AS l, POSSTR(n_name, 'AN') AS p, STRIP('  x ') AS s FROM nation",
        "SELECT n_nationkey, CAST(instr(n_name, 'A') AS INTEGER) AS l, CAST(instr(n_name, 'AN') AS INTEGER) AS p, 'x' AS s FROM nation",
    ),
    "ora_instr4": (
        "oracle",
        "SELECT n_nationkey, INSTR(n_name, 'A', 1, 2) AS i FROM nation",
        "SELECT n_nationkey, CAST(coalesce([i for i in range(1, length(n_name) + 1) if n_name[i] = 'A'][2], 0) AS INTEGER) AS i FROM nation",
    ),
    "ora_translate": ("oracle", "SELECT n_nationkey, TRANSLATE(n_name, 'AEI', 'aei') AS t, TRANSLATE(n_name USING CHAR_CS) AS u FROM nation", "SELECT n_nationkey, translate(n_name, 'AEI', 'aei') AS t, n_name AS u FROM nation"),
    "ora_regexp_split": (
        "oracle",
        "SELECT REGEXP_SUBSTR('a,b,c', '[^,]+', 1, LEVEL) AS part FROM dual CONNECT BY LEVEL <= 3",
        "SELECT unnest(['a', 'b', 'c']) AS part",
    ),
    "ora_regexp": (
        "oracle",
        "SELECT n_nationkey, REGEXP_REPLACE(n_name, '[AEIOU]', '*') AS r, REGEXP_SUBSTR(n_name, '[AEIOU]+') AS s FROM nation WHERE REGEXP_LIKE(n_name, 'A')",
        "SELECT n_nationkey, regexp_replace(n_name, '[AEIOU]', '*', 'g') AS r, nullif(regexp_extract(n_name, '[AEIOU]+'), '') AS s FROM nation WHERE regexp_matches(n_name, 'A')",
    ),
    "ora_dual": ("oracle", "SELECT 1 + 1 AS two, SYS_CONTEXT('USERENV', 'TERMINAL') AS t FROM dual", "SELECT 2 AS two, CAST(NULL AS VARCHAR) AS t"),
    "quantified": (
        "mysql",
        "SELECT n_name FROM nation WHERE n_nationkey >= ALL (SELECT n_nationkey FROM nation) OR n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')",
        "SELECT n_name FROM nation WHERE n_nationkey >= (SELECT max(n_nationkey) FROM nation) OR n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')",
    ),
    "ora_pivot": (
        "oracle",
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS done, 'O' AS opened))",
        "SELECT o_orderpriority, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS opened FROM orders GROUP BY o_orderpriority",
    ),
    "ora_unpivot": (
        "oracle",
        "SELECT n_name, what, k FROM (SELECT n_name, n_nationkey, n_regionkey FROM nation) UNPIVOT (k FOR what IN (n_nationkey, n_regionkey AS region))",
        "SELECT n_name, 'N_NATIONKEY' AS what, n_nationkey AS k FROM nation UNION ALL SELECT n_name, 'region', n_regionkey FROM nation",
    ),
    "ora_collection_table": (
        "oracle",
        "SELECT n.n_nationkey, t.column_value AS part FROM nation n, TABLE(SPLIT(n.n_name, '_')) t",
        "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS part FROM nation",
    ),
    "tpch_q3": (
        "mysql",
        "SELECT l.l_orderkey, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c, orders o, lineitem l WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < '1995-03-15' AND l.l_shipdate > '1995-03-15' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10",
        "SELECT l.l_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c, orders o, lineitem l WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < '1995-03-15' AND l.l_shipdate > '1995-03-15' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10",
    ),
    "tpch_q5": (
        "oracle",
        "SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c, orders o, lineitem l, supplier s, nation n, region r WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' GROUP BY n.n_name",
        "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c, orders o, lineitem l, supplier s, nation n, region r WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' GROUP BY n.n_name",
    ),
}


def views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temporary views over the driver's tables."""
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _runner(dialect: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return query(spark, sql, dialect)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import introspect_queries, operator_queries, order_queries, routine_queries, schema_queries, search_queries, table_queries, version_queries

    return {name: _runner(dialect, sql) for name, (dialect, sql, _) in (SQL | dialect_queries.SQL).items()} | operator_queries.queries() | schema_queries.queries() | routine_queries.queries() | introspect_queries.queries() | search_queries.queries() | version_queries.queries() | order_queries.queries() | table_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import introspect_queries, operator_queries, order_queries, routine_queries, schema_queries, search_queries, table_queries, version_queries

    return {name: twin for name, (_, _, twin) in (SQL | dialect_queries.SQL).items()} | operator_queries.oracle_sql() | schema_queries.oracle_sql() | routine_queries.oracle_sql() | introspect_queries.oracle_sql() | search_queries.oracle_sql() | version_queries.oracle_sql() | order_queries.oracle_sql() | table_queries.oracle_sql()
