"""Places in an order, frames, sequences in queries, hierarchies, routed inserts and foreign-key actions: edges beside the queries that equal DuckDB."""

import pytest
from pyspark.sql import functions as F

from tessera.dialects import query, translate
from tessera.dialects.ddl import ForeignKey
from tessera.dialects.lexer import SqlError
from tessera.functions import masks
from tessera.operators import actions, dml, ordering
from tessera.operators.sequences import Sequence


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_places_are_the_sort(spark):
    df = spark.range(0, 1000, 1, 7).select("id", (F.col("id") * 37 % 101).alias("k"))
    got, total = ordering.placed(df, [F.col("k").desc(), F.col("id").asc()])
    assert total == 1000
    want = sorted(range(1000), key=lambda i: (-(i * 37 % 101), i))
    assert [r.id for r in got.orderBy("_place").collect()] == want
    assert sorted(r._place for r in got.collect()) == list(range(1000))
    assert [r.id for r in ordering.between(df, [F.col("id").asc()], 10, 3).orderBy("id").collect()] == [10, 11, 12]
    empty, none = ordering.placed(df.where("false"), [F.col("id").asc()])
    assert none == 0 and empty.collect() == []


def test_percent_has_no_window_over_everything(spark):
    spark.range(0, 500, 1, 4).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("k")).createOrReplaceTempView("placed_rows")
    df = query(spark, "SELECT id, k FROM placed_rows ORDER BY k DESC, id FETCH FIRST 12 PERCENT ROWS ONLY", "oracle")
    nulls = [i for i in range(500) if i % 9 == 0]
    rest = sorted((i for i in range(500) if i % 9), key=lambda i: (-(i % 50), i))
    assert [r.id for r in df.collect()] == (nulls + rest)[:60]  # NULL is high in Oracle
    assert "Window" not in df._jdf.queryExecution().toString()


def test_numbers_of_sequences(spark):
    spark.range(5).createOrReplaceTempView("five")
    sq = {"s": Sequence("s", 10, -2)}
    got = query(spark, "SELECT id, s.NEXTVAL AS a, s.NEXTVAL AS b, 'x' AS c FROM five WHERE id > 1", "oracle", sequences=sq).collect()
    assert sorted(r.a for r in got) == [6, 8, 10] and all(r.a == r.b and r.c == "x" for r in got)
    assert query(spark, "SELECT s.CURRVAL AS v FROM dual", "oracle", sequences=sq).first().v == 6
    for bad in ("SELECT DISTINCT s.NEXTVAL FROM five", "SELECT t.NEXTVAL FROM five", "SELECT id FROM five WHERE s.NEXTVAL > 1"):
        with pytest.raises(SqlError):
            query(spark, bad, "oracle", sequences=sq)
    with pytest.raises(ValueError):
        query(spark, "SELECT s.CURRVAL FROM dual", "oracle", sequences={"s": Sequence("s")})


def test_frames_that_have_no_form():
    over = "SELECT SUM(a) OVER (ORDER BY b {}) FROM t"
    for bad in ("RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP", "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE TIES"):
        with pytest.raises(SqlError):
            translate(over.format(bad), "oracle")
    with pytest.raises(SqlError):
        translate("SELECT SUM(a) OVER (GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "oracle")
    with pytest.raises(SqlError):
        translate("SELECT STDDEV(a) OVER (ORDER BY b ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) FROM t", "oracle")
    assert "EXCLUDE" not in translate(over.format("ROWS 1 PRECEDING EXCLUDE NO OTHERS"), "oracle").sql


def test_frames_over_nulls_and_ties(spark):
    data = [(1, 1, None), (2, 1, 5), (3, 2, None), (4, 2, None), (5, 3, 7), (6, None, 9)]
    spark.createDataFrame(data, "id int, k int, x int").createOrReplaceTempView("tied")
    got = query(spark, "SELECT id, SUM(x) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, COUNT(x) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS n, MAX(x) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS m FROM tied", "oracle")
    assert rows(got) == sorted([(1, 5, 0, None), (2, 5, 0, 5), (3, 5, 2, 7), (4, 5, 2, 7), (5, 7, 1, 9), (6, 16, 1, 9)], key=repr)


def test_siblings_need_their_parent():
    with pytest.raises(SqlError):
        translate("SELECT a FROM t CONNECT BY PRIOR a < b ORDER SIBLINGS BY a", "oracle")
    with pytest.raises(SqlError):
        translate("SELECT CONNECT_BY_ISCYCLE FROM t CONNECT BY PRIOR a = b", "oracle")


def test_insert_all_keeps_rows_that_no_arm_takes(spark):
    spark.createDataFrame([(1, None), (2, 5)], "k int, v int").createOrReplaceTempView("src_rows")
    spark.createDataFrame([], "k int, v int").createOrReplaceTempView("into_a")
    got = dml.insert_all(spark, "INSERT ALL WHEN v > 3 THEN INTO into_a WHEN v > 4 THEN INTO into_a VALUES (-k, DEFAULT) SELECT k, v FROM src_rows")
    assert list(got) == ["into_a"] and rows(got["into_a"].table) == [(-2, None), (2, 5)]
    with pytest.raises(SqlError):
        dml.insert_all(spark, "INSERT INTO into_a VALUES (1, 2)")


def test_changes_with_a_limit(spark):
    spark.createDataFrame([(i % 3, i) for i in range(9)], "k int, v int").createOrReplaceTempView("few")
    left = dml.execute(spark, "DELETE FROM few WHERE k < 2 ORDER BY v DESC LIMIT 4", "mysql").table
    assert rows(left) == sorted([(i % 3, i) for i in range(9) if i not in (7, 6, 4, 3)], key=repr)
    assert dml.execute(spark, "DELETE FROM few LIMIT 0", "mysql").table.count() == 9
    new = dml.execute(spark, "UPDATE few SET k = v + 10 WHERE v > 2 ORDER BY v LIMIT 2", "mysql").table
    assert rows(new) == sorted([(i + 10 if i in (3, 4) else i % 3, i) for i in range(9)], key=repr)


def test_actions_of_a_key_to_itself(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5), (7, 7)], "id int, up int")
    notes = spark.createDataFrame([(10, 3), (11, 6), (12, None)], "n int, node int")
    foreign = {"tree": [ForeignKey(["up"], ("tree",), ["id"], on_delete="CASCADE")], "notes": [ForeignKey(["node"], ("tree",), ["id"], on_delete="SET NULL")]}
    left = actions.delete_with_actions({"tree": tree, "notes": notes}, foreign, "tree", "id IN (2, 7)")
    assert rows(left["tree"]) == [(1, None), (5, None), (6, 5)]
    assert rows(left["notes"]) == [(10, None), (11, 6), (12, None)]
    foreign["notes"][0].on_delete = ""
    with pytest.raises(actions.Restricted):
        actions.delete_with_actions({"tree": tree, "notes": notes}, foreign, "tree", "id = 2")
    same = actions.delete_with_actions({"tree": tree, "notes": notes}, foreign, "tree", "id = 99")
    assert rows(same["tree"]) == rows(tree)


def test_number_masks():
    for bad in ("9,99", "X", "9.9.9", "S9S", ""):
        with pytest.raises(masks.MaskError):
            masks.number_mask(bad)
    for dated in ("999", "$0.00"):
        with pytest.raises(masks.MaskError):
            masks.oracle_pattern(dated)
    m = masks.number_mask("FM$9,990.09")
    assert (m.whole, m.forced, m.decimals, m.kept, m.grouped, m.dollar, m.fill) == (4, 1, 2, 1, True, True, True)


def test_groups_frames_are_frames_of_a_table_of_groups(spark):
    """NULL keys, empty frames and exclusions of every aggregate, against plain Python; no window sorts the rows themselves."""
    rows = [(i, [None, "p", "q"][i % 3], [None, 1, 2, 2, 3, 5, 5][i % 7], None if i % 5 == 0 else i) for i in range(60)]
    spark.createDataFrame(rows, "id int, p string, k int, x int").createOrReplaceTempView("grouped_rows")
    shapes = {"GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING": (-1, 1), "GROUPS 2 PRECEDING": (-2, 0), "GROUPS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING": (-99, -2), "GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING": (1, 99)}
    place = {None: 99, 1: 1, 2: 2, 3: 3, 5: 4}  # Oracle: NULL is high
    for excluded in ("", " EXCLUDE GROUP", " EXCLUDE TIES"):
        for shape, (low, high) in shapes.items():
            over = f"OVER (PARTITION BY p ORDER BY k {shape}{excluded})"
            df = query(spark, f"SELECT id, SUM(x) {over} AS s, COUNT(*) {over} AS c, COUNT(x) {over} AS n, MIN(x) {over} AS a, MAX(x) {over} AS b, AVG(x) {over} AS m FROM grouped_rows g WHERE id <> 7", "oracle")
            plan = df._jdf.queryExecution().analyzed().toString()
            assert "dense_rank" not in plan
            for got in df.collect():
                i, p, k, _ = rows[got.id]
                same = [r for r in rows if r[1] == p and r[0] != 7]
                groups = sorted({place[r[2]] for r in same})
                at = groups.index(place[k])
                near = {g for j, g in enumerate(groups) if at + low <= j <= at + high}
                held = [r for r in same if place[r[2]] in near and not (excluded and place[r[2]] == place[k] and not (excluded.endswith("TIES") and r[0] == i))]
                xs = [r[3] for r in held if r[3] is not None]
                want = (sum(xs) if xs else None, len(held), len(xs), min(xs, default=None), max(xs, default=None), sum(xs) / len(xs) if xs else None)
                assert tuple(got)[1:] == pytest.approx(want), (excluded, shape, got)
