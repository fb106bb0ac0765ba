from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import coerce as C
from tessera.operators import dml
from tessera.operators.copy import copy_table, read_copy, validate
from tessera.operators.ranges import key_ranges
from tessera.operators.sequences import Sequence, SequenceStore
from tessera.sources import JdbcSource, dictionary_views
from tessera.streaming import follow


@given(st.integers(-(10**12), 10**12), st.integers(0, 10**9), st.integers(1, 10**6), st.lists(st.floats(-1e12, 1e12)))
@settings(max_examples=200, deadline=None)
def test_ranges_are_disjoint_and_hold_every_key(low, span, width, keys):
    ranges = key_ranges(low, low + span, width)
    assert len(ranges) <= 10_001
    for k in [low, low + span, low + span / 2, *keys]:
        assert sum((r.low is None or k >= r.low) and (r.high is None or k < r.high) for r in ranges) == 1


def one(spark, value, kind, target):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return df.select(C.coerce(F.col("v"), kind, target).alias("x")).first().x


@pytest.mark.parametrize(
    "value, kind, target, want",
    [
        (2, T.IntegerType(), "boolean", True), (0, T.IntegerType(), "boolean", False), ("yes", T.StringType(), "boolean", False), ("1", T.StringType(), "boolean", True), (None, T.StringType(), "boolean", None),
        (b"\x01", T.BinaryType(), "boolean", True), (b"\x00", T.BinaryType(), "boolean", False), (b"y", T.BinaryType(), "boolean", True), (b"", T.BinaryType(), "boolean", False), (b"0", T.BinaryType(), "boolean", False),
        (300, T.IntegerType(), "tinyint", None), (70_000, T.LongType(), "smallint", None), ("12", T.StringType(), "int", 12), ("x", T.StringType(), "int", None), (b"7", T.BinaryType(), "bigint", 7), (3.0, T.DoubleType(), "int", 3),
        ("a\0b", T.StringType(), "string", "ab"), (b"h\xc3\xa9", T.BinaryType(), "string", "hé"), (b"\xff\x01", T.BinaryType(), "string", "1111111100000001"), (datetime(2020, 1, 2, 3), T.TimestampNTZType(), "string", "2020-01-02T03:00:00.000000Z"),
        ("", T.StringType(), "array<string>", []), ("a,b", T.StringType(), "array<string>", ["a", "b"]), ("9:05:00", T.StringType(), "time(0)", "09:05:00"), ("25:00:00", T.StringType(), "time(0)", None),
    ],
)
def test_coercion(spark, value, kind, target, want):
    assert one(spark, value, kind, target) == want


def test_losses_are_counted_and_replays_do_not_double(spark, tmp_path):
    df = spark.createDataFrame([(i, 40_000 if i % 10 == 0 else i) for i in range(2_500)], "id long, small int")
    path = str(tmp_path / "t")
    assert copy_table(df, path, {"id": "bigint", "small": "smallint"}, "id", 100).lost == {"small": 250}
    copy_table(df, path, {"id": "bigint", "small": "smallint"}, "id", 100, only=[3, 4])
    assert read_copy(spark, path).count() == 2_500
    r = validate(df.select("id"), read_copy(spark, path).select("id")).first()
    assert r.same_rows and r.same_values
    assert not validate(df, read_copy(spark, path)).first().same_values


def test_a_replay_means_the_width_asked_for_whatever_the_keys(spark, tmp_path):
    """More than 10,000 batches lie together in folders; a replay of two still touches the keys of these two alone."""
    path = str(tmp_path / "w")
    old = spark.range(-50, 3_000).withColumn("v", F.lit("old")).union(spark.createDataFrame([(90_000_000, "old"), (None, "old")], "id long, v string"))
    copy_table(old.where("id >= 300 OR id IS NULL OR id < 0"), path, {"id": "tinyint", "v": "string"}, "id", 100)
    new = old.withColumn("v", F.lit("new"))
    assert copy_table(new, path, {"id": "tinyint", "v": "string"}, "id", 100, only=[0, 3, -1]).rows == 250
    got = read_copy(spark, path)
    assert got.columns == ["id", "v"] and got.where("v = 'new'").count() == 250 and got.count() == 3_052 - 200
    copy_table(new, path, {"id": "tinyint", "v": "string"}, "id", 100, only=[0, 3, -1])
    assert read_copy(spark, path).count() == 3_052 - 200


def test_a_table_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, s string")
    assert copy_table(df, str(tmp_path / "e"), {"id": "int", "s": "string"}, "id").rows == 0
    assert validate(df, df).first().same_rows


def test_sequences(spark, tmp_path):
    store = SequenceStore(str(tmp_path / "s"))
    s = store.create("S", start=10, step=5)
    got = sorted(r.n for r in s.numbered(spark.range(0, 20, 1, 4), "n").collect())
    assert got == list(range(10, 110, 5)) and s.currval() == 105
    store.save()
    assert SequenceStore(str(tmp_path / "s")).all["s"].take(1) == 110
    with pytest.raises(OverflowError):
        Sequence("x", high=3).take(4)
    c = Sequence("c", low=1, high=3, cycle=True)
    assert [c.take(1) for _ in range(5)] == [1, 2, 3, 1, 2]


def test_merge_of_doubled_source_rows_is_an_error(spark):
    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("tgt")
    spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string").createOrReplaceTempView("src")
    with pytest.raises(ValueError):
        dml.execute(spark, "MERGE INTO tgt USING src ON (tgt.k = src.k) WHEN MATCHED THEN UPDATE SET tgt.v = src.v", "oracle")


def test_changes_report_their_rows(spark):
    spark.createDataFrame([(i, "x", None) for i in range(5)], "k int, v string, w string").createOrReplaceTempView("tgt")
    c = dml.execute(spark, "UPDATE tgt SET v = 'y' WHERE k > 2 AND w IS NULL", "mysql")
    assert c.changed.count() == 2 and c.table.count() == 5
    c = dml.execute(spark, "DELETE FROM tgt WHERE w = 'q' OR k = 1", "oracle")
    assert c.changed.count() == 1 and c.table.count() == 4
    c = dml.execute(spark, "REPLACE INTO tgt (k, v) VALUES (1, 'new'), (9, 'new')", "mysql", keys=["k"])
    assert c.table.count() == 6 and c.table.where("v = 'new'").count() == 2


def test_jdbc_texts():
    s = JdbcSource(None, "oracle", JdbcSource.url_for("oracle", "h", 1521, "XE"), "HR")
    assert s.qualified("T") == '"HR"."T"' and s.url == "jdbc:oracle:thin:@//h:1521/XE"
    p = s.predicates("ID", key_ranges(1, 30, 10))
    assert p == ['("ID" < 11) OR "ID" IS NULL', '"ID" >= 11 AND "ID" < 21', '"ID" >= 21']
    assert "NOT IN ('information_schema'" in JdbcSource(None, "mysql", "").schemas_sql()


def test_dictionary_views(spark):
    from tessera.dialects import query

    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("dict_probe")
    dictionary_views(spark)
    got = query(spark, "SELECT column_name, column_id FROM all_tab_columns WHERE table_name = 'DICT_PROBE' ORDER BY column_id", "oracle").collect()
    assert [r.column_name for r in got] == ["K", "V"]


def test_streaming_copy(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.range(10).write.parquet(src)
    assert follow(spark, src, out, {"id": "int"}, check) == 10
    assert follow(spark, src, out, {"id": "int"}, check) == 0
    spark.range(10, 15).write.mode("append").parquet(src)
    assert follow(spark, src, out, {"id": "int"}, check) == 5
    assert read_copy(spark, out).count() == 15


def test_update_beside_a_table_takes_one_match(spark):
    from tessera.operators import dml

    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "k int, v string").createOrReplaceTempView("ut")
    spark.createDataFrame([(2, "x"), (2, "x"), (5, "q")], "k int, v string").createOrReplaceTempView("us")
    change = dml.execute(spark, "UPDATE ut JOIN us ON ut.k = us.k SET ut.v = us.v", "mysql")
    assert sorted(map(tuple, change.table.collect()), key=repr) == [(1, "a"), (2, "x"), (2, "x"), (None, "n")]
    assert change.changed.count() == 2


def test_delete_by_a_subquery_with_nulls(spark):
    from tessera.operators import dml

    spark.createDataFrame([(1,), (2,), (None,)], "k int").createOrReplaceTempView("dt")
    spark.createDataFrame([(1,), (None,)], "k int").createOrReplaceTempView("ds")
    assert sorted((r.k for r in dml.execute(spark, "DELETE FROM dt WHERE k IN (SELECT k FROM ds)", "mysql").table.collect()), key=repr) == [2, None]
    assert dml.execute(spark, "DELETE FROM dt WHERE k NOT IN (SELECT k FROM ds)", "mysql").table.count() == 3


def test_repeated_keys_of_a_query_are_an_error(spark):
    from tessera.operators import dml

    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("it")
    spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string").createOrReplaceTempView("iq")
    change = dml.execute(spark, "INSERT INTO it SELECT k, v FROM iq ON DUPLICATE KEY UPDATE v = VALUES(v)", "mysql", keys=["k"])
    with pytest.raises(Exception, match="share a key"):
        change.table.collect()


def test_delete_and_update_by_subqueries_join_by_key(spark):
    """NOT IN and IN with NULLs on either side and over no rows, alone and inside a condition; nothing compares all pairs."""
    left, right = [1, 2, 3, None], {"some": [1, 3], "nulls": [1, None], "none": []}
    spark.createDataFrame([(k, "a") for k in left], "k int, v string").createOrReplaceTempView("jt")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    for name, own in right.items():
        spark.createDataFrame([(k,) for k in own], "k int").createOrReplaceTempView("js")
        into = lambda k: False if not own else True if k is not None and k in own else None if k is None or None in own else False
        opposite = lambda x: None if x is None else not x
        for sql, holds in (("k NOT IN (SELECT k FROM js)", lambda k: opposite(into(k))), ("k IN (SELECT k FROM js)", into), ("k = 2 OR k NOT IN (SELECT k FROM js)", lambda k: True if k == 2 else opposite(into(k))), ("NOT (k IN (SELECT k FROM js WHERE k > 0))", None)):
            if holds is None:
                full = [x for x in own if x]
                holds = lambda k, full=full: True if not full else None if k is None else k not in full
            change = dml.execute(spark, f"DELETE FROM jt WHERE {sql}", "oracle")
            assert sorted((r.k for r in change.table.collect()), key=repr) == sorted((k for k in left if holds(k) is not True), key=repr), (name, sql)
            assert sorted((r.k for r in change.changed.collect()), key=repr) == sorted((k for k in left if holds(k) is True), key=repr), (name, sql)
            assert "NestedLoop" not in change.table._jdf.queryExecution().explainString(mode).replace("BroadcastNestedLoopJoin BuildRight, Inner", "")
            done = dml.execute(spark, f"UPDATE jt SET v = 'b' WHERE {sql}", "oracle").table.where("v = 'b'").collect()
            assert sorted((r.k for r in done), key=repr) == sorted((k for k in left if holds(k) is True), key=repr), (name, sql)


def test_delete_by_a_subquery_of_the_outer_row(spark):
    spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k int, w int").createOrReplaceTempView("ct")
    spark.createDataFrame([(1, 5), (2, 7), (3, 1)], "k2 int, w2 int").createOrReplaceTempView("cs")
    change = dml.execute(spark, "DELETE FROM ct WHERE w IN (SELECT w2 FROM cs WHERE k2 = k)", "mysql")
    assert sorted(r.k for r in change.table.collect()) == [2, 3]
