"""Named queries for the operators: copies, coercions, constraints, data changes, partitions, scripts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import coerce as C
from .operators import constraints, dml, partitioning
from .operators.copy import copy_table, read_copy, validate
from .shared import shared_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


_ORDERS = {"o_orderkey": "bigint", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "decimal(12,2)"}


def copy_pk_ranges(spark, d):
    path = _path(spark, "copy")
    copy_table(_t(spark, d, "orders"), path, _ORDERS, key="o_orderkey", width=1_000)
    return read_copy(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def copy_no_pk(spark, d):
    path = _path(spark, "copy")
    copy_table(_t(spark, d, "part"), path, {"p_name": "string", "p_size": "smallint"})
    return read_copy(spark, path).groupBy("p_size").agg(F.count("*").alias("n")).select(F.col("p_size").cast("int").alias("p_size"), "n")


def copy_idempotent(spark, d):
    path = _path(spark, "copy")
    orders = _t(spark, d, "orders")
    copy_table(orders, path, _ORDERS, key="o_orderkey", width=1_000)
    copy_table(orders, path, _ORDERS, key="o_orderkey", width=1_000, only=[0, 1])
    return read_copy(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def copy_replay_after_lower_key(spark, d):
    """Keys from 10 on are copied, then lower ones arrive and one batch is replayed: no row is lost."""
    path = _path(spark, "copy")
    orders = _t(spark, d, "orders")
    copy_table(orders.where("o_orderkey >= 300"), path, _ORDERS, key="o_orderkey", width=100)
    copy_table(orders, path, _ORDERS, key="o_orderkey", width=100, only=[0, 3])
    return read_copy(spark, path).select("o_orderkey", "o_orderstatus")


def copy_sparse_keys(spark, d):
    """A key whose values are far apart: batches are as wide as their number allows."""
    path = _path(spark, "copy")
    own = _t(spark, d, "nation").select((F.col("n_nationkey").cast("long") * 1_000_000_007).alias("id"), "n_name")
    copy_table(own, path, {"id": "bigint", "n_name": "string"}, key="id", width=10)
    return read_copy(spark, path).select("id", F.col("n_name").alias("name"))


def copy_losses(spark, d):
    """What a copy into too narrow a column loses, counted by the job that writes it."""
    got = copy_table(_t(spark, d, "orders"), _path(spark, "copy"), {"o_orderkey": "tinyint", "o_totalprice": "double"}, key="o_orderkey", width=1_000)
    return spark.createDataFrame([(got.rows, got.lost.get("o_orderkey", 0), got.lost.get("o_totalprice", 0))], "copied long, lost_keys long, lost_prices long")


def coerce_float_trunc(spark, d):
    c = F.col("c_acctbal") - 0.5
    return _t(spark, d, "customer").select("c_custkey", C.coerce(c, T.DoubleType(), "bigint").alias("whole"), C.coerce(c.cast("decimal(12,2)"), T.DecimalType(12, 2), "int").alias("from_decimal"), C.coerce(c, T.DoubleType(), "tinyint").cast("int").alias("tiny"))


def coerce_timestamp_utc(spark, d):
    """Text of timestamps is in UTC whatever the session's zone is."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    at = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("n_nationkey") * 3_600)
    return _t(spark, d, "nation").select("n_nationkey", C.coerce(at, T.TimestampType(), "string").alias("s"), F.lit(zone != "").alias("zoned"))


def coerce_to_text(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", C.coerce(F.col("o_orderkey"), T.LongType(), "string").alias("whole"), C.coerce(F.col("o_totalprice").cast("decimal(12,2)"), T.DecimalType(12, 2), "string").alias("price"))


def validate_counts(spark, d):
    got = validate(_t(spark, d, "nation"), _t(spark, d, "nation").where("n_nationkey <> 3"))
    return got.select("source_rows", "target_rows", "same_rows")


def validate_checksum(spark, d):
    nation = _t(spark, d, "nation")
    return validate(nation, nation.orderBy(F.desc("n_name"))).select("same_rows", "same_values")


def coerce_unsigned_overflow(spark, d):
    big = F.col("o_orderkey") * 1_000_000
    return _t(spark, d, "orders").select("o_orderkey", C.coerce(big, T.LongType(), "int").alias("as_int"), C.coerce(F.concat(F.col("o_orderkey").cast("string"), F.lit("x")), T.StringType(), "bigint").alias("as_long"))


def coerce_bool(spark, d):
    c = F.col("n_regionkey")
    return _t(spark, d, "nation").select("n_nationkey", C.to_bool(c, T.IntegerType()).alias("num"), C.to_bool(F.element_at(F.array(*map(F.lit, ["0", "1", "yes", "", "2.5"])), c + 1), T.StringType()).alias("text"))


def coerce_set_array(spark, d):
    c = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat_ws(",", F.col("n_regionkey").cast("string"), "n_name"))
    return _t(spark, d, "nation").select("n_nationkey", F.size(C.to_set(c)).alias("n"), F.array_join(C.to_set(c), "|").alias("s"))


def coerce_time_range(spark, d):
    values = F.array(*map(F.lit, ["-01:00:00", "23:59:59", "24:00:00", "", "838:59:59"]))
    return _t(spark, d, "region").select("r_regionkey", C.to_time(F.element_at(values, F.col("r_regionkey") + 1)).alias("t"))


def coerce_interval(spark, d):
    values = F.array(*map(F.lit, ["+01-06", "-02-00", "00-11", "bad", "+10-01"]))
    days = F.array(*map(F.lit, ["+01 02:03:04.5", "-00 00:00:01.1234567", "10 00:00:00", "bad", "+00 00:00:00"]))
    k = F.col("r_regionkey") + 1
    return _t(spark, d, "region").select("r_regionkey", C.to_year_month(F.element_at(values, k)).alias("months"), C.to_day_second(F.element_at(days, k)).alias("micros"))


def coerce_nul_strip(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", C.strip_nul(F.concat("n_name", F.lit("\0"), F.lit("z"))).alias("s"))


def coerce_bits(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", C.bits(F.encode("n_name", "UTF-8")).alias("b"))


def check_violations(spark, d):
    return constraints.check_violations(_t(spark, d, "lineitem"), "l_discount <= 0.05 AND l_quantity > 0").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def pk_violations(spark, d):
    return constraints.key_violations(_t(spark, d, "lineitem"), ["l_orderkey"]).select("l_orderkey", "n")


def fk_orphans(spark, d):
    return constraints.orphans(_t(spark, d, "orders"), ["o_custkey"], _t(spark, d, "customer").where("c_nationkey < 20"), ["c_custkey"]).select("o_orderkey")


def enum_violations(spark, d):
    return constraints.enum_violations(_t(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey")


def set_subset_violations(spark, d):
    own = _t(spark, d, "part").withColumn("words", F.split("p_type", " "))
    return constraints.subset_violations(own, "words", ["STANDARD", "SMALL", "ANODIZED", "TIN", "BRASS"]).select("p_partkey")


def _views(spark, d):
    from .queries import views

    views(spark, d)


def my_upsert(spark, d):
    _views(spark, d)
    sql = "INSERT INTO nation (n_nationkey, n_name, n_regionkey) SELECT n_nationkey + 20, UCASE(n_name), n_regionkey FROM nation ON DUPLICATE KEY UPDATE n_name = CONCAT(n_name, '/', VALUES(n_name)), n_regionkey = 9"
    return dml.execute(spark, sql, "mysql", keys=["n_nationkey"]).table


def my_upsert_repeated_keys(spark, d):
    """Rows of VALUES that share a key act one after the other."""
    _views(spark, d)
    sql = "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'b'), (1, 'c'), (7, 'd'), (7, 'e'), (NULL, 'x'), (NULL, 'y') ON DUPLICATE KEY UPDATE r_name = CONCAT(r_name, '+', VALUES(r_name))"
    return dml.execute(spark, sql, "mysql", keys=["r_regionkey"]).table


def my_replace_last(spark, d):
    _views(spark, d)
    return dml.execute(spark, "REPLACE INTO region VALUES (1, 'b'), (1, 'c'), (8, 'd'), (8, 'e')", "mysql", keys=["r_regionkey"]).table


def my_insert_ignore_nulls(spark, d):
    _views(spark, d)
    return dml.execute(spark, "INSERT IGNORE INTO region VALUES (NULL, 'x'), (NULL, 'y'), (9, 'first'), (9, 'second')", "mysql", keys=["r_regionkey"]).table


def dml_returning(spark, d):
    """The rows that an UPDATE wrote."""
    _views(spark, d)
    return dml.execute(spark, "UPDATE nation SET n_name = n_name || '!' WHERE n_regionkey = 3", "oracle").changed


def my_insert_ignore(spark, d):
    _views(spark, d)
    return dml.execute(spark, "INSERT IGNORE INTO region VALUES (1, 'AGAIN'), (7, 'NEW')", "mysql", keys=["r_regionkey"]).table


def insert_select(spark, d):
    _views(spark, d)
    return dml.execute(spark, "INSERT INTO region (r_name, r_regionkey) SELECT n_name, n_nationkey + 100 FROM nation WHERE n_regionkey = 2", "oracle").table


def update_simple(spark, d):
    _views(spark, d)
    return dml.execute(spark, "UPDATE nation SET n_name = 'X' || n_name, n_regionkey = n_regionkey + 10 WHERE n_nationkey < 5", "oracle").table


def update_join(spark, d):
    _views(spark, d)
    return dml.execute(spark, "UPDATE nation n JOIN region r ON n.n_regionkey = r.r_regionkey SET n.n_name = CONCAT(r.r_name, ':', n.n_name) WHERE r.r_name LIKE 'A%'", "mysql").table


def update_tuple(spark, d):
    _views(spark, d)
    return dml.execute(spark, "UPDATE nation n SET (n_name, n_regionkey) = (SELECT MAX(r.r_name), MAX(r.r_regionkey) + 50 FROM region r WHERE r.r_regionkey = n.n_regionkey) WHERE n.n_nationkey > 10", "oracle").table


def delete_using(spark, d):
    _views(spark, d)
    return dml.execute(spark, "DELETE n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", "mysql").table


def delete_subquery(spark, d):
    _views(spark, d)
    return dml.execute(spark, "DELETE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "db2").table.select("c_custkey")


_MERGE = "MERGE INTO nation t USING (SELECT n_nationkey + 12 AS k, n_name AS nm, n_regionkey AS r FROM nation) s ON (t.n_nationkey = s.k) "


def ora_merge(spark, d):
    _views(spark, d)
    return dml.execute(spark, _MERGE + "WHEN MATCHED THEN UPDATE SET t.n_name = s.nm WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name, n_regionkey) VALUES (s.k, s.nm, s.r)", "oracle").table


def ora_merge_conditional(spark, d):
    _views(spark, d)
    sql = _MERGE + "WHEN MATCHED THEN UPDATE SET t.n_regionkey = s.r + 10 WHERE s.r > 0 DELETE WHERE t.n_regionkey = 11 WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name) VALUES (s.k, s.nm) WHERE s.r < 3"
    return dml.execute(spark, sql, "oracle").table


def range_bucket_counts(spark, d):
    p = partitioning.range_partition(F.col("p_size"), [("small", 10), ("mid", 30), ("rest", None)])
    return _t(spark, d, "part").groupBy(p.alias("part")).agg(F.count("*").alias("n"))


def list_bucket_default(spark, d):
    p = partitioning.list_partition(F.col("o_orderstatus"), [("done", ["F"]), ("open", ["O"])], "other")
    return _t(spark, d, "orders").groupBy(p.alias("part")).agg(F.count("*").alias("n"))


def hash_bucket_counts(spark, d):
    return _t(spark, d, "orders").groupBy(partitioning.hash_partition(F.col("o_orderkey"), 8, modulo=True).alias("part")).agg(F.count("*").alias("n"))


def interval_bucket(spark, d):
    return _t(spark, d, "orders").groupBy(partitioning.interval_partition(F.col("o_orderdate"), "month").alias("m")).agg(F.count("*").alias("n"))


def sql_scalar_fn(spark, d):
    from .dialects.procedural import create_function

    create_function(spark, "CREATE FUNCTION net_price(p NUMBER, d NUMBER) RETURN NUMBER IS BEGIN RETURN ROUND(p * (1 - d), 2); END;", "oracle")
    _views(spark, d)
    return spark.sql("SELECT l_orderkey, l_linenumber, CAST(net_price(CAST(l_extendedprice AS DECIMAL(12,2)), CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net FROM lineitem")


def script_loop_sum(spark, d):
    from .dialects.procedural import run_block

    return run_block(spark, "DECLARE s NUMBER(10) := 0; i NUMBER(10) := 1; BEGIN WHILE i <= 10 LOOP s := s + i * i; i := i + 1; END LOOP; END;", "oracle", "SELECT s AS total")


def script_cursor_for(spark, d):
    from .dialects.procedural import run_block

    _views(spark, d)
    sql = "DECLARE s NUMBER(18) := 0; BEGIN FOR r IN (SELECT n_nationkey, n_regionkey FROM nation) LOOP IF r.n_regionkey > 2 THEN s := s + r.n_nationkey; ELSE s := s + 1; END IF; END LOOP; END;"
    return run_block(spark, sql, "oracle", "SELECT s AS total")


def sql_table_fn(spark, d):
    from .dialects.procedural import create_function

    _views(spark, d)
    create_function(spark, "CREATE FUNCTION nations_of(r INT) RETURNS TABLE (k INT, name VARCHAR(30)) LANGUAGE SQL RETURN SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r", "db2")
    return spark.sql("SELECT k, name FROM nations_of(2)")


def exec_immediate_using(spark, d):
    from .dialects.procedural import run_block

    _views(spark, d)
    sql = "DECLARE x NUMBER(18); BEGIN EXECUTE IMMEDIATE 'SELECT COUNT(*) FROM nation WHERE n_regionkey = :1 AND n_nationkey > :2' INTO x USING 2, 5; END;"
    return run_block(spark, sql, "oracle", "SELECT x AS n")


_ALL = (
    copy_pk_ranges, copy_no_pk, copy_idempotent, copy_replay_after_lower_key, copy_sparse_keys, copy_losses, coerce_float_trunc, coerce_timestamp_utc, coerce_to_text,
    my_upsert_repeated_keys, my_replace_last, my_insert_ignore_nulls, dml_returning, validate_counts, validate_checksum, coerce_unsigned_overflow, coerce_bool, coerce_set_array, coerce_time_range, coerce_interval, coerce_nul_strip, coerce_bits,
    check_violations, pk_violations, fk_orphans, enum_violations, set_subset_violations, my_upsert, my_insert_ignore, insert_select, update_simple, update_join, update_tuple, delete_using, delete_subquery, ora_merge,
    ora_merge_conditional, range_bucket_counts, list_bucket_default, hash_bucket_counts, interval_bucket, sql_scalar_fn, script_loop_sum, script_cursor_for, sql_table_fn, exec_immediate_using,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "copy_pk_ranges": "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS o_totalprice FROM orders",
        "copy_replay_after_lower_key": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 100 OR o_orderkey >= 300",
        "copy_sparse_keys": "SELECT CAST(n_nationkey AS BIGINT) * 1000000007 AS id, n_name AS name FROM nation",
        "copy_losses": "SELECT count(*) AS copied, count(*) FILTER (WHERE o_orderkey > 127) AS lost_keys, CAST(0 AS BIGINT) AS lost_prices FROM orders",
        "coerce_float_trunc": "SELECT c_custkey, CAST(trunc(c_acctbal - 0.5) AS BIGINT) AS whole, CAST(trunc(CAST(c_acctbal - 0.5 AS DECIMAL(12,2))) AS INTEGER) AS from_decimal, CASE WHEN trunc(c_acctbal - 0.5) BETWEEN -128 AND 127 THEN CAST(trunc(c_acctbal - 0.5) AS INTEGER) END AS tiny FROM customer",
        "coerce_timestamp_utc": "SELECT n_nationkey, strftime(TIMESTAMP '2020-01-01 00:00:00' + n_nationkey * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.000000Z') AS s, true AS zoned FROM nation",
        "coerce_to_text": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS whole, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM orders",
        "my_upsert_repeated_keys": "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || '+b+c' ELSE r_name END AS r_name FROM region UNION ALL VALUES (7, 'd+e'), (NULL, 'x'), (NULL, 'y')",
        "my_replace_last": "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'c' ELSE r_name END AS r_name FROM region UNION ALL SELECT CAST(8 AS INTEGER), 'e'",
        "my_insert_ignore_nulls": "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (NULL, 'x'), (NULL, 'y'), (9, 'first')",
        "dml_returning": "SELECT n_nationkey, n_name || '!' AS n_name, n_regionkey FROM nation WHERE n_regionkey = 3",
        "copy_no_pk": "SELECT p_size, count(*) AS n FROM part GROUP BY p_size",
        "copy_idempotent": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
        "validate_counts": "SELECT count(*) AS source_rows, count(*) FILTER (WHERE n_nationkey <> 3) AS target_rows, count(*) = count(*) FILTER (WHERE n_nationkey <> 3) AS same_rows FROM nation",
        "validate_checksum": "SELECT true AS same_rows, true AS same_values",
        "coerce_unsigned_overflow": "SELECT o_orderkey, TRY_CAST(o_orderkey * 1000000 AS INTEGER) AS as_int, CAST(NULL AS BIGINT) AS as_long FROM orders",
        "coerce_bool": "SELECT n_nationkey, n_regionkey <> 0 AS num, n_regionkey IN (1, 4) AS text FROM nation",
        "coerce_set_array": "SELECT n_nationkey, CAST(CASE WHEN n_regionkey = 0 THEN 0 ELSE 2 END AS INTEGER) AS n, CASE WHEN n_regionkey = 0 THEN '' ELSE n_regionkey || '|' || n_name END AS s FROM nation",
        "coerce_time_range": "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN '23:59:59' END AS t FROM region",
        "coerce_interval": "SELECT r_regionkey, CAST([18, -24, 11, NULL, 121][r_regionkey + 1] AS INTEGER) AS months, CAST([93784500000, -1123456, 864000000000, NULL, 0][r_regionkey + 1] AS BIGINT) AS micros FROM region",
        "coerce_nul_strip": "SELECT n_nationkey, n_name || 'z' AS s FROM nation",
        "coerce_bits": "SELECT n_nationkey, CAST(encode(n_name)::BIT AS VARCHAR) AS b FROM nation",
        "check_violations": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_discount <= 0.05 AND l_quantity > 0) GROUP BY l_returnflag",
        "pk_violations": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
        "fk_orphans": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
        "enum_violations": "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
        "set_subset_violations": "SELECT p_partkey FROM part WHERE len([w for w in string_split(p_type, ' ') if w NOT IN ('STANDARD', 'SMALL', 'ANODIZED', 'TIN', 'BRASS')]) > 0",
        "my_upsert": "SELECT n.n_nationkey, CASE WHEN s.k IS NULL THEN n.n_name ELSE n.n_name || '/' || s.nm END AS n_name, CASE WHEN s.k IS NULL THEN n.n_regionkey ELSE 9 END AS n_regionkey FROM nation n LEFT JOIN (SELECT n_nationkey + 20 AS k, upper(n_name) AS nm FROM nation) s ON n.n_nationkey = s.k UNION ALL SELECT n_nationkey + 20, upper(n_name), n_regionkey FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)",
        "my_insert_ignore": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(7 AS INTEGER), 'NEW'",
        "insert_select": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2",
        "update_simple": "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'X' || n_name ELSE n_name END AS n_name, CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation",
        "update_join": "SELECT n_nationkey, CASE WHEN r_name LIKE 'A%' THEN r_name || ':' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey",
        "update_tuple": "SELECT n_nationkey, CASE WHEN n_nationkey > 10 THEN r_name ELSE n_name END AS n_name, CASE WHEN n_nationkey > 10 THEN r_regionkey + 50 ELSE n_regionkey END AS n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
        "delete_using": "SELECT nation.* FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
        "delete_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        "ora_merge": "SELECT n.n_nationkey, coalesce(s.nm, n.n_name) AS n_name, n.n_regionkey FROM nation n LEFT JOIN (SELECT n_nationkey + 12 AS k, n_name AS nm FROM nation) s ON n.n_nationkey = s.k UNION ALL SELECT n_nationkey + 12, n_name, n_regionkey FROM nation WHERE n_nationkey + 12 NOT IN (SELECT n_nationkey FROM nation)",
        "ora_merge_conditional": "SELECT n.n_nationkey, n.n_name, CASE WHEN s.r > 0 THEN s.r + 10 ELSE n.n_regionkey END AS n_regionkey FROM nation n LEFT JOIN (SELECT n_nationkey + 12 AS k, n_regionkey AS r FROM nation) s ON n.n_nationkey = s.k WHERE NOT coalesce(s.r = 1, false) UNION ALL SELECT n_nationkey + 12, n_name, NULL FROM nation WHERE n_regionkey < 3 AND n_nationkey + 12 NOT IN (SELECT n_nationkey FROM nation)",
        "range_bucket_counts": "SELECT CASE WHEN p_size < 10 OR p_size IS NULL THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'rest' END AS part, count(*) AS n FROM part GROUP BY 1",
        "list_bucket_default": "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS part, count(*) AS n FROM orders GROUP BY 1",
        "hash_bucket_counts": "SELECT CAST(o_orderkey % 8 AS INTEGER) AS part, count(*) AS n FROM orders GROUP BY 1",
        "interval_bucket": "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1",
        "sql_scalar_fn": "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS net FROM lineitem",
        "sql_table_fn": "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 2",
        "exec_immediate_using": "SELECT count(*) AS n FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5",
        "script_loop_sum": "SELECT CAST(385 AS BIGINT) AS total",
        "script_cursor_for": "SELECT CAST(sum(CASE WHEN n_regionkey > 2 THEN n_nationkey ELSE 1 END) AS BIGINT) AS total FROM nation",
    }
