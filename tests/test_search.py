"""Full text, geometry and vectors: odd searches, nulls, ties and shapes, beside the queries that equal DuckDB."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.dialects import query, translate
from tessera.dialects.lexer import SqlError
from tessera.functions import geometry
from tessera.operators import fulltext, spatial, vectors

DOCS = [(1, "The quick brown fox", "fox"), (2, "quick quick QUICK", None), (3, None, None), (4, "brown quick the fox's den", "x"), (5, "straße über alles_da 42", ""), (None, "quick", None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "id int, body string, more string")
    df.createOrReplaceTempView("ft_docs")
    return df


SEARCHES = {
    "quick": {1, 2, 4},
    "+quick -fox": {2},
    '"quick brown"': {1},
    '"brown quick"': {4},
    "bro*": {1, 4},
    "+(fox den) +brown": {1, 4},
    "(fox (den -brown))": {1, 4},
    "-quick": set(),
    "": set(),
    "über STRASSE straße alles_da": {5},
    "42": {5},
    '"fox s den"': {4},
    "+quick* ~brown": {1, 2, 4},
}


@pytest.mark.parametrize("text", SEARCHES)
def test_boolean_searches_scan_and_index(spark, docs, text):
    keyed = docs.where("id IS NOT NULL")
    keyed.createOrReplaceTempView("ft_keyed")
    index = fulltext.build(docs, "id", ["body"])
    sql = f"SELECT id, MATCH(body) AGAINST('{text}' IN BOOLEAN MODE) AS r FROM ft_keyed WHERE MATCH(body) AGAINST('{text}' IN BOOLEAN MODE)"
    scan, found = query(spark, sql, "mysql").collect(), query(spark, sql, "mysql", fulltext={"ft_keyed": index}).collect()
    assert {r.id for r in scan} == {r.id for r in found} == SEARCHES[text]
    assert {r.id: round(r.r, 9) for r in scan} == {r.id: round(r.r, 9) for r in found}


def test_match_in_other_places(spark, docs):
    sql = "SELECT COUNT(*) AS n, SUM(CASE WHEN NOT MATCH(body, more) AGAINST('fox') THEN 1 ELSE 0 END) AS no FROM ft_docs d WHERE id > 0 OR MATCH(d.body) AGAINST('quick')"
    assert tuple(query(spark, sql, "mysql").first()) == (6, 4)


def test_searches_that_are_errors(spark, docs):
    for text in ("+", "(a", "a)", "+ -b"):
        with pytest.raises(fulltext.SearchError):
            fulltext.boolean(text)
    with pytest.raises(SqlError):
        translate("SELECT 1 FROM t WHERE MATCH(a) AGAINST(b)", "mysql")
    with pytest.raises(SqlError):
        translate("SELECT 1 FROM t WHERE MATCH(a) AGAINST('b' WITH QUERY EXPANSION)", "mysql")
    with pytest.raises(ValueError):
        fulltext.build(docs.union(docs), "id", ["body"])


def test_index_reads_the_words_of_a_search_alone(spark, docs):
    index = fulltext.build(docs, "id", ["body", "more"])
    plan = index.search(spark, fulltext.boolean("fox*"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(word,fox)" in plan
    assert index.search(spark, ()).count() == 0


def geo(spark, sql):
    geometry.register(spark, sql)
    return spark.sql("SELECT " + sql).first()[0]


SHAPE = "geo_parse('POLYGON((0 0, 10 0, 10 10, 5 5, 0 10, 0 0))')"  # not convex
RING = "geo_parse('POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))')"


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        (f"geo_contains({SHAPE}, geo_point(5, 4))", True),
        (f"geo_contains({SHAPE}, geo_point(5, 6))", False),
        (f"geo_intersects({SHAPE}, geo_box(4.5, 6, 5.5, 9))", False),
        (f"geo_touches({SHAPE}, geo_box(4, 5, 6, 9))", False),
        (f"geo_overlaps({SHAPE}, geo_box(4, 5, 6, 9))", True),
        (f"geo_covers({RING}, geo_box(3, 3, 6, 6))", False),
        (f"geo_touches({RING}, geo_box(3, 3, 6, 6))", True),
        (f"geo_covers({RING}, geo_box(2, 2, 4, 4))", False),
        (f"geo_overlaps({RING}, geo_box(2, 2, 4, 4))", True),
        (f"geo_contains(geo_box(0, 0, 9, 9), {RING})", True),
        (f"geo_equals({RING}, {RING})", True),
        (f"geo_distance({RING}, geo_point(4, 5))", 1.0),
        ("geo_covers(geo_parse('LINESTRING(0 0, 5 5, 9 5)'), geo_parse('LINESTRING(2 2, 5 5, 6 5)'))", True),
        ("geo_touches(geo_parse('LINESTRING(0 0, 5 5)'), geo_parse('LINESTRING(5 5, 9 0)'))", True),
        ("geo_intersects(geo_parse('LINESTRING(0 0, 4 4)'), geo_parse('LINESTRING(0 4, 4 0)'))", True),
        ("geo_distance(geo_parse('LINESTRING(0 0, 0 9)'), geo_parse('LINESTRING(3 4, 9 9)'))", 3.0),
        ("geo_distance(geo_point(1, 1), CAST(NULL AS STRUCT<dim: INT, rings: ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>))", None),
        ("geo_area(geo_parse(NULL))", None),
        ("geo_point(NULL, 1)", None),
    ],
)
def test_relations(spark, sql, want):
    assert geo(spark, sql) == want


def test_boxes_relate_as_their_bounds_do(spark):
    """Random boxes on a small grid, so that sides and corners often coincide."""
    rnd = random.Random(2)
    box = lambda: (x := rnd.randrange(5), y := rnd.randrange(5), x + rnd.randrange(1, 4), y + rnd.randrange(1, 4))
    pairs = [(i, *box(), *box()) for i in range(200)]
    df = spark.createDataFrame(pairs, "i int, a int, b int, c int, d int, e int, f int, g int, h int")
    told = ["geo_intersects(x, y)", "geo_covers(x, y)", "geo_covers(y, x)", "geo_touches(x, y)", "geo_overlaps(x, y)", "geo_equals(x, y)", "geo_distance(x, y)"]
    geometry.register(spark, " ".join(told) + " geo_box")
    got = df.selectExpr("i", "geo_box(a, b, c, d) AS x", "geo_box(e, f, g, h) AS y").selectExpr("i", *told)
    for i, meets, covers, within, touches, overlaps, equals, apart in map(tuple, got.collect()):
        _, a, b, c, d, e, f, g, h = pairs[i]
        w, t = min(c, g) - max(a, e), min(d, h) - max(b, f)
        inside = lambda p, q: p[0] <= q[0] and p[1] <= q[1] and p[2] >= q[2] and p[3] >= q[3]
        one, two = (a, b, c, d), (e, f, g, h)
        assert meets == (w >= 0 and t >= 0)
        assert covers == inside(one, two) and within == inside(two, one) and equals == (one == two)
        assert touches == (meets and not (w > 0 and t > 0))
        assert overlaps == (w > 0 and t > 0 and not inside(one, two) and not inside(two, one))
        assert apart == pytest.approx((max(-w, 0) ** 2 + max(-t, 0) ** 2) ** 0.5)


def test_spatial_join_of_many_sizes(spark):
    """Boxes from a thousandth to a thousand wide, points and rows without a geometry: the pairs of a nested loop, each once."""
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(-500, 500), rnd.uniform(-500, 500), 10 ** rnd.uniform(-3, 3) if i % 3 else 0.0) for i in range(250)] + [(900, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double, w double")
    geometry.register(spark, "geo_point geo_box")
    df = df.selectExpr("i", "x", "y", "w", "if(w = 0, geo_point(x, y), geo_box(x, y, x + w, y + w)) AS geom")
    pairs = lambda r: sorted((a["i"], b["i"]) for a, b in r.collect())
    got = pairs(spatial.spatial_join(df, df, "geom", "geom"))
    want = sorted((a, b) for a, x, y, w in rows[:-1] for b, u, v, z in rows[:-1] if x <= u + z and u <= x + w and y <= v + z and v <= y + w)
    assert got == want
    near = pairs(spatial.spatial_join(df.where("w = 0"), df, "geom", "geom", distance=7.5))
    far = lambda p, low, w: max(low - p, p - low - w, 0)
    assert near == sorted((a, b) for a, x, y, w in rows[:-1] if w == 0 for b, u, v, z in rows[:-1] if (far(x, u, z) ** 2 + far(y, v, z) ** 2) ** 0.5 <= 7.5)


def test_vector_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 6)), 2)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [0.0] * 6), (302, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    every = np.vstack([x, x[:1]])
    keys = [*range(300), 302]
    for metric in ("euclidean", "cosine", "dot"):
        index = vectors.build(df, "id", "v", metric, cells=8)
        asked = df.where("id % 50 = 0 OR id = 302")
        got = {}
        for q, n, _, place in index.search(asked, "id", "v", 5).select("query", "neighbour", "distance", "place").collect():
            got.setdefault(q, {})[place] = n
        for q in got:
            y = x[q] if q < 300 else x[0]
            d = {"euclidean": ((every - y) ** 2).sum(1), "cosine": 1 - every @ y / np.linalg.norm(every, axis=1) / np.linalg.norm(y), "dot": -(every @ y)}[metric]
            assert np.allclose(sorted(d)[:5], [d[keys.index(got[q][p])] for p in range(1, 6)])
        assert set(got) == {0, 50, 100, 150, 200, 250, 302}
    recalls = vectors.build(df, "id", "v", "euclidean", cells=8).recalls(df.where("id % 50 = 0"), "id", "v", 5)
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_large_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rows = [(i, [1.0, float(i % 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    index = vectors.build(df, "id", "v", "euclidean", cells=2)
    assert max(index.blocks) > 2
    got = [r.neighbour for r in index.search(df.where("id = 0"), "id", "v", 4).orderBy("place").collect()]
    assert got == [0, 3, 6, 9]


def test_searches_meet_in_blocks_and_keep_ties_exact(spark, monkeypatch):
    """Copies of vectors, zero, huge and odd queries: what distance_sql() says of every pair, and no pair is a row of the plan."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "SHARE", 64)
    rng = np.random.default_rng(3)
    x = [[float(c) for c in v] for v in rng.normal(size=(40, 5)) / 3] + [[0.0] * 5, [1e-170] * 5, [0.1] * 5]
    rows = [(f"k{i:03d}", x[i % len(x)]) for i in range(215)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    odd = [("inf", [float("inf"), 0.0, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 5), ("null", [None, 1.0, 1.0, 1.0, 1.0]), ("short", [1.0]), ("big", [1e200] * 5)]
    asked = df.where("id like '%0'").union(spark.createDataFrame(odd, "id string, v array<double>"))
    for metric in ("euclidean", "cosine", "dot"):
        index = vectors.build(df, "id", "v", metric, cells=6)
        assert max(s + b for s, b in zip(index.shards, index.blocks)) > 2
        told = F.expr(vectors.distance_sql("a.v", "b.v", metric))
        order = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "neighbour")
        pairs = asked.alias("a").crossJoin(df.alias("b")).select(F.col("a.id").alias("query"), F.col("b.id").alias("neighbour"), told.alias("distance"))
        want = pairs.withColumn("place", F.row_number().over(order)).where("place <= 7")
        found = index.search(asked, "id", "v", 7)
        key = lambda r: (r.query, r.place, r.neighbour, repr(r.distance))
        assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
        assert "aggregate(" not in found._jdf.queryExecution().toString()
        near = index.search(df.where("id like '%0'"), "id", "v", 7, 2)
        cells = spark.read.parquet(index.path).select("key", "cell").collect()
        home = {r.key: r.cell for r in cells}
        unit = metric == "cosine"
        true = {q: [] for q, _ in rows if q.endswith("0")}
        own = dict(rows)
        for r in sorted((r for r in pairs.collect() if r.query in true), key=lambda r: (r.distance is None, r.distance or 0.0, r.neighbour)):
            v = np.array([own[r.query]])
            if home[r.neighbour] in vectors._nearest(vectors._unit(v) if unit else v, index.centres, 2)[0]:
                true[r.query].append(r.neighbour)
        got = {}
        for r in near.orderBy("place").collect():
            got.setdefault(r.query, []).append(r.neighbour)
        assert got == {q: t[:7] for q, t in true.items() if t}
