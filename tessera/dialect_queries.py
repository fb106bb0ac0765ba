"""More named queries in the dialects beside DuckDB's twin: patterns, dates, JSON, hierarchies, samples of daily surface."""

from __future__ import annotations

#: name: (dialect, SQL of the dialect, SQL of DuckDB)
SQL: dict[str, tuple[str, str, str]] = {
    # patterns
    "ora_regexp_replace_flags": (
        "oracle",
        "SELECT n_nationkey, REGEXP_REPLACE(n_name, 'a', '-', 1, 1, 'i') AS first_a, REGEXP_REPLACE(n_name, 'a', '-', 1, 0, 'i') AS every_a, REGEXP_REPLACE(n_name, 'A', '-', 3) AS from_third, REGEXP_REPLACE(n_name, '([AEIOU])([A-Z])', '\\2\\1', 1, 2) AS second_pair FROM nation",
        "SELECT n_nationkey, regexp_replace(n_name, 'a', '-', 'i') AS first_a, regexp_replace(n_name, 'a', '-', 'gi') AS every_a, substr(n_name, 1, 2) || regexp_replace(substr(n_name, 3), 'A', '-', 'g') AS from_third, "
        "CASE WHEN len(regexp_extract_all(n_name, '[AEIOU][A-Z]')) < 2 THEN n_name ELSE substr(n_name, 1, instr(n_name, regexp_extract(n_name, '[AEIOU][A-Z]')) + 1) || regexp_replace(substr(n_name, instr(n_name, regexp_extract(n_name, '[AEIOU][A-Z]')) + 2), '([AEIOU])([A-Z])', '\\2\\1') END AS second_pair FROM nation",
    ),
    "ora_regexp_substr_occurrence": (
        "oracle",
        "SELECT p_partkey, REGEXP_SUBSTR(p_type, '[A-Z]+', 1, 2) AS w2, REGEXP_SUBSTR(p_type, '([a-z]+) ([a-z]+)', 1, 1, 'i', 2) AS g2, REGEXP_COUNT(p_type, 's', 1, 'i') AS n_s, REGEXP_INSTR(p_type, ' ', 3) AS gap FROM part",
        "SELECT p_partkey, regexp_extract_all(p_type, '[A-Z]+')[2] AS w2, nullif(regexp_extract(p_type, '([a-zA-Z]+) ([a-zA-Z]+)', 2), '') AS g2, CAST(len(regexp_extract_all(lower(p_type), 's')) AS INTEGER) AS n_s, CAST(CASE WHEN instr(substr(p_type, 3), ' ') = 0 THEN 0 ELSE instr(substr(p_type, 3), ' ') + 2 END AS INTEGER) AS gap FROM part",
    ),
    "my_regexp_like_flags": (
        "mysql",
        "SELECT n_name FROM nation WHERE REGEXP_LIKE(n_name, '^[a-m]', 'i') AND NOT REGEXP_LIKE(n_name, '^[a-m]', 'c')",
        "SELECT n_name FROM nation WHERE regexp_matches(n_name, '^[a-mA-M]') AND NOT regexp_matches(n_name, '^[a-m]')",
    ),
    # aggregates and windows
    "ora_listagg_over": (
        "oracle",
        "SELECT n_nationkey, LISTAGG(n_name, ';') WITHIN GROUP (ORDER BY n_regionkey, n_name DESC) OVER (PARTITION BY MOD(n_nationkey, 3)) AS names FROM nation",
        "SELECT n_nationkey, names FROM nation JOIN (SELECT n_nationkey % 3 AS m, string_agg(n_name, ';' ORDER BY n_regionkey, n_name DESC) AS names FROM nation GROUP BY 1) ON m = n_nationkey % 3",
    ),
    "ora_keep_dense_rank": (
        "oracle",
        "SELECT c_nationkey, MIN(c_name) KEEP (DENSE_RANK FIRST ORDER BY c_mktsegment) AS first_name, MAX(c_acctbal) KEEP (DENSE_RANK LAST ORDER BY c_mktsegment) AS last_bal, MAX(c_name) KEEP (DENSE_RANK FIRST ORDER BY c_custkey) AS first_cust FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, min(c_name) FILTER (WHERE c_mktsegment = lo) AS first_name, max(c_acctbal) FILTER (WHERE c_mktsegment = hi) AS last_bal, max(c_name) FILTER (WHERE c_custkey = k) AS first_cust "
        "FROM (SELECT *, min(c_mktsegment) OVER w AS lo, max(c_mktsegment) OVER w AS hi, min(c_custkey) OVER w AS k FROM customer WINDOW w AS (PARTITION BY c_nationkey)) GROUP BY c_nationkey",
    ),
    "ora_ratio_to_report": (
        "oracle",
        "SELECT s_suppkey, ROUND(RATIO_TO_REPORT(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier",
        "SELECT s_suppkey, round(s_acctbal / nullif(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 6) AS share FROM supplier",
    ),
    "ora_percentile_disc": (
        "oracle",
        "SELECT c_mktsegment, PERCENTILE_DISC(0.25) WITHIN GROUP (ORDER BY c_custkey) AS q FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, CAST(quantile_disc(c_custkey, 0.25) AS DOUBLE) AS q FROM customer GROUP BY c_mktsegment",
    ),
    "db2_array_agg": (
        "db2",
        "SELECT n_regionkey, CARDINALITY(ARRAY_AGG(n_name)) AS n FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey",
    ),
    "ora_with_ties_two_keys": (
        "oracle",
        "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem ORDER BY l_quantity DESC, l_tax FETCH FIRST 7 ROWS WITH TIES",
        "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC, l_tax) AS r FROM lineitem) WHERE r <= 7",
    ),
    "ora_rownum_between": (
        "oracle",
        "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders WHERE ROWNUM BETWEEN 1 AND 25)",
        "SELECT CAST(25 AS BIGINT) AS n",
    ),
    # joins
    "ora_plus_both_sides": (
        "oracle",
        "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a, (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 9) b WHERE a.k(+) = b.k(+)",
        "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 9) b ON a.k = b.k",
    ),
    "ora_cross_apply": (
        "oracle",
        "SELECT n.n_name, t.c_name FROM nation n CROSS APPLY (SELECT c_name FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey FETCH FIRST 1 ROW ONLY) t",
        "SELECT n.n_name, t.c_name FROM nation n, LATERAL (SELECT c_name FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t",
    ),
    "ora_outer_apply": (
        "oracle",
        "SELECT n.n_name, t.s FROM nation n OUTER APPLY (SELECT SUM(s_acctbal) AS s FROM supplier s WHERE s.s_nationkey = n.n_nationkey GROUP BY s_nationkey) t",
        "SELECT n.n_name, t.s FROM nation n LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS s FROM supplier GROUP BY s_nationkey) t ON t.s_nationkey = n.n_nationkey",
    ),
    "my_join_tree_two_on": (
        "mysql",
        "SELECT r.r_name, COUNT(*) AS n FROM region r JOIN (nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey) ON n.n_regionkey = r.r_regionkey ON r.r_regionkey > 0 GROUP BY r.r_name",
        "SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey WHERE r.r_regionkey > 0 GROUP BY r.r_name",
    ),
    # conditions and literals
    "my_numeric_truth": (
        "mysql",
        "SELECT n_nationkey, NOT 0 AS yes, n_nationkey AND 1 AS both_set, n_regionkey XOR 1 AS differs FROM nation WHERE n_regionkey OR 0",
        "SELECT n_nationkey, true AS yes, n_nationkey <> 0 AS both_set, NOT (n_regionkey <> 0) AS differs FROM nation WHERE n_regionkey <> 0",
    ),
    "my_charset_introducer": ("mysql", "SELECT n_nationkey, CONCAT(_utf8mb4'n:', n_name) AS s FROM nation", "SELECT n_nationkey, 'n:' || n_name AS s FROM nation"),
    "my_literals": (
        "mysql",
        "SELECT n_nationkey, b'101' AS five, HEX(x'4D7953') AS hexed, TRUE AS t, NULL AS nothing, 'a' 'b' AS joined, 1e3 AS big FROM nation",
        "SELECT n_nationkey, CAST(5 AS INTEGER) AS five, '4D7953' AS hexed, true AS t, NULL AS nothing, 'ab' AS joined, CAST(1000 AS DOUBLE) AS big FROM nation",
    ),
    "my_hints_and_locks": (
        "mysql",
        "SELECT SQL_NO_CACHE n_name FROM nation USE INDEX (pk) WHERE n_regionkey = 1 ORDER BY n_name LIMIT 3 FOR UPDATE",
        "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 3",
    ),
    "db2_isolation_clause": ("db2", "SELECT n_name FROM nation WHERE n_regionkey = 2 WITH UR", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    # numbers, text, dates
    "ora_round_date": (
        "oracle",
        "SELECT o_orderkey, ROUND(o_orderdate, 'MM') AS m, ROUND(o_orderdate, 'YYYY') AS y, ROUND(o_orderdate, 'Q') AS q, ROUND(o_orderdate + 0.6) AS d FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', CASE WHEN day(o_orderdate) >= 16 THEN o_orderdate + INTERVAL 1 MONTH ELSE o_orderdate END) AS TIMESTAMP) AS m, CAST(date_trunc('year', CASE WHEN month(o_orderdate) >= 7 THEN o_orderdate + INTERVAL 1 YEAR ELSE o_orderdate END) AS TIMESTAMP) AS y, "
        "CAST(date_trunc('quarter', CASE WHEN o_orderdate >= date_trunc('quarter', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 15 DAY THEN date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH ELSE o_orderdate END) AS TIMESTAMP) AS q, CAST(date_trunc('day', o_orderdate + INTERVAL 51840 SECOND + INTERVAL 12 HOUR) AS TIMESTAMP) AS d FROM orders",
    ),
    "my_char_length_concat": (
        "mysql",
        "SELECT n_nationkey, CHAR_LENGTH(n_name) AS n, CHARACTER_LENGTH(CONCAT(n_name, 'é')) AS m, LENGTH(CONCAT('é', n_name)) AS bytes, CONCAT(n_name, NULL) AS nothing, CONCAT('<', n_name, '>') AS tag FROM nation",
        "SELECT n_nationkey, CAST(length(n_name) AS INTEGER) AS n, CAST(length(n_name) + 1 AS INTEGER) AS m, CAST(strlen(n_name) + 2 AS INTEGER) AS bytes, CAST(NULL AS VARCHAR) AS nothing, '<' || n_name || '>' AS tag FROM nation",
    ),
    "now_functions_agree": (
        "mysql",
        "SELECT n_nationkey, NOW() >= CURDATE() AS later, DATE(NOW()) = CURDATE() AS same_day, CURRENT_TIMESTAMP = NOW() AS same FROM nation",
        "SELECT n_nationkey, true AS later, true AS same_day, true AS same FROM nation",
    ),
    "ora_sysdate_seconds": (
        "oracle",
        "SELECT n_nationkey, EXTRACT(SECOND FROM SYSDATE) = TRUNC(EXTRACT(SECOND FROM SYSDATE)) AS whole, SYSDATE <= SYSTIMESTAMP AS before FROM nation",
        "SELECT n_nationkey, true AS whole, true AS before FROM nation",
    ),
    "db2_current_date": (
        "db2",
        "SELECT n_nationkey, CURRENT DATE = DATE(CURRENT TIMESTAMP) AS same, YEAR(CURRENT DATE) > 2000 AS modern FROM nation",
        "SELECT n_nationkey, true AS same, true AS modern FROM nation",
    ),
    "my_uuid_shape": ("mysql", "SELECT n_nationkey, CHAR_LENGTH(UUID()) AS n FROM nation", "SELECT n_nationkey, CAST(36 AS INTEGER) AS n FROM nation"),
    "ora_to_char_one_argument": ("oracle", "SELECT n_nationkey, TO_CHAR(n_nationkey) AS s FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS s FROM nation"),
    "ora_translate_using": (
        "oracle",
        "SELECT n_nationkey, TRANSLATE(n_name USING CHAR_CS) AS same, TRANSLATE(n_name, 'AEI', 'aei') AS low FROM nation",
        "SELECT n_nationkey, n_name AS same, translate(n_name, 'AEI', 'aei') AS low FROM nation",
    ),
    "ora_dbms_lob": (
        "oracle",
        "SELECT n_nationkey, DBMS_LOB.SUBSTR(n_name, 3, 2) AS part, DBMS_LOB.GETLENGTH(n_name) AS n, DBMS_LOB.INSTR(n_name, 'A', 1, 2) AS second_a FROM nation",
        "SELECT n_nationkey, substr(n_name, 2, 3) AS part, CAST(length(n_name) AS INTEGER) AS n, CAST(CASE WHEN instr(n_name, 'A') > 0 AND instr(substr(n_name, instr(n_name, 'A') + 1), 'A') > 0 THEN instr(n_name, 'A') + instr(substr(n_name, instr(n_name, 'A') + 1), 'A') ELSE 0 END AS INTEGER) AS second_a FROM nation",
    ),
    "ora_sys_prefix": ("oracle", "SELECT n_nationkey, SYS.NVL(NULL, n_name) AS s FROM nation", "SELECT n_nationkey, n_name AS s FROM nation"),
    "ora_sys_context": ("oracle", "SELECT n_nationkey, SYS_CONTEXT('USERENV', 'CURRENT_SCHEMA') AS s FROM nation", "SELECT n_nationkey, 'default' AS s FROM nation"),
    # JSON
    "my_json_unquote": (
        "mysql",
        "SELECT event_id, JSON_UNQUOTE(JSON_EXTRACT(props, '$.k')) AS k, JSON_VALID(props) AS good, JSON_VALID(event_type) AS bad FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS good, json_valid(event_type) AS bad FROM events",
    ),
    "ora_json_object": (
        "oracle",
        "SELECT n_nationkey, JSON_OBJECT('k' VALUE n_nationkey, KEY 'name' VALUE n_name, 'none' VALUE NULL) AS j FROM nation",
        "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null}' AS j FROM nation",
    ),
    "ora_json_table": (
        "oracle",
        "SELECT n.n_nationkey, t.pos, t.a, t.b FROM nation n, JSON_TABLE('[{\"a\": 1, \"b\": \"x\"}, {\"a\": ' || n.n_nationkey || '}]', '$[*]' COLUMNS (pos FOR ORDINALITY, a NUMBER(9,0) PATH '$.a', b VARCHAR2(10) PATH '$.b')) t",
        "SELECT n_nationkey, CAST(1 AS INTEGER) AS pos, CAST(1 AS INTEGER) AS a, 'x' AS b FROM nation UNION ALL SELECT n_nationkey, CAST(2 AS INTEGER), CAST(n_nationkey AS INTEGER), NULL FROM nation",
    ),
    # hierarchies
    "ora_connect_by_nocycle": (
        "oracle",
        "SELECT k, LEVEL AS depth, CONNECT_BY_ROOT k AS root, SYS_CONNECT_BY_PATH(k, '/') AS path FROM (SELECT n_nationkey AS k, MOD(n_nationkey + 1, 5) AS next FROM nation WHERE n_nationkey < 5) t START WITH k = 2 CONNECT BY NOCYCLE PRIOR next = k",
        "SELECT (2 + i) % 5 AS k, CAST(i + 1 AS INTEGER) AS depth, CAST(2 AS INTEGER) AS root, substr('/2/3/4/0/1', 1, 2 * (i + 1)) AS path FROM (SELECT CAST(i AS INTEGER) AS i FROM range(5) t(i))",
    ),
    "ora_connect_by_path": (
        "oracle",
        "SELECT n_name, CONNECT_BY_ROOT n_name AS top, SYS_CONNECT_BY_PATH(n_name, ' > ') AS path, LEVEL AS depth FROM nation START WITH n_nationkey = 0 CONNECT BY PRIOR n_nationkey = n_regionkey AND n_nationkey > n_regionkey",
        "WITH RECURSIVE t AS (SELECT n_nationkey, n_name, n_name AS top, ' > ' || n_name AS path, 1 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, n.n_name, t.top, t.path || ' > ' || n.n_name, t.depth + 1 FROM t JOIN nation n ON n.n_regionkey = t.n_nationkey AND n.n_nationkey > n.n_regionkey) SELECT n_name, top, path, depth FROM t",
    ),
    "ora_sample_all": ("oracle", "SELECT COUNT(*) AS n FROM nation SAMPLE (100)", "SELECT count(*) AS n FROM nation"),
    "ora_collection_constructor": (
        "oracle",
        "SELECT COLUMN_VALUE AS v FROM TABLE(SYS.ODCIVARCHAR2LIST('a', 'b', 'c'))",
        "SELECT unnest(['a', 'b', 'c']) AS v",
    ),
    "ora_multiset_count": (
        "oracle",
        "SELECT r_name, CARDINALITY(CAST(MULTISET(SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS name_list)) AS n FROM region r",
        "SELECT r_name, CAST((SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS INTEGER) AS n FROM region r",
    ),
}
