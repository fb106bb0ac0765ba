"""Named queries for what indexes serve: full text, geometry and vectors, over the driver's tables, beside DuckDB's twins."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialects import query
from .functions import geometry
from .operators import fulltext, spatial, vectors
from .schema.plan import plan_schema
from .shared import shared_dir


def _views(spark: SparkSession, d: str, *names: str) -> None:
    for t in names:
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)


# --- full text ------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BOOLEAN = "+the -was \"and the\" tion* <license"


def _ranked(spark, d, sql: str, indexed: bool) -> DataFrame:
    _views(spark, d, "documents")
    if not indexed:
        return query(spark, sql, "mysql")
    index = fulltext.build(spark.table("documents"), "doc_id", ["text"])
    return query(spark, sql, "mysql", fulltext={"documents": index})


_NATURAL_SQL = "SELECT doc_id, ROUND(MATCH(text) AGAINST('Apache license mit lizenz'), 6) AS r FROM documents WHERE MATCH(text) AGAINST('Apache license mit lizenz')"
_PHRASE_SQL = "SELECT d.doc_id, d.lang FROM documents d WHERE MATCH(d.text) AGAINST('\"public license\" \"apache license version\"' IN BOOLEAN MODE)"
_BOOLEAN_SQL = "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('+the -was \"and the\" tion* <license' IN BOOLEAN MODE)"
_GROUPS_SQL = "SELECT lang, COUNT(*) AS n FROM documents WHERE MATCH(text) AGAINST('+(und the) +(>de <of) -licen*' IN BOOLEAN MODE) OR doc_id < 3 GROUP BY lang"


def ft_natural_scan(spark, d):
    return _ranked(spark, d, _NATURAL_SQL, False)


def ft_natural_index(spark, d):
    return _ranked(spark, d, _NATURAL_SQL, True)


def ft_phrase_index(spark, d):
    return _ranked(spark, d, _PHRASE_SQL, True)


def ft_phrase_scan(spark, d):
    return _ranked(spark, d, _PHRASE_SQL, False)


def ft_boolean_index(spark, d):
    return _ranked(spark, d, _BOOLEAN_SQL, True)


def ft_groups_index(spark, d):
    return _ranked(spark, d, _GROUPS_SQL, True)


def ft_ddl_key(spark, d):
    """A FULLTEXT KEY over two columns, declared in DDL, built over a table and searched."""
    plan = plan_schema("CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name VARCHAR(60), p_type VARCHAR(30), FULLTEXT KEY words (p_name, p_type));", "mysql")
    _views(spark, d, "part")
    index = plan.tables["part"].built(spark.table("part"))["words"]
    return query(spark, "SELECT p_partkey, ROUND(MATCH(p_name, p_type) AGAINST('brushed tin'), 6) AS r FROM part WHERE MATCH(p_name, p_type) AGAINST('+brushed tin' IN BOOLEAN MODE)", "mysql", fulltext={"part": index})


_RANK_TWIN = (
    "WITH w AS (SELECT {key}, {words} AS ws FROM {table}), t AS (SELECT unnest({terms}) AS term), "
    "c AS (SELECT {key}, term, len([x for x in ws if x = term]) AS n FROM w, t), i AS (SELECT term, count(*) FILTER (WHERE n > 0) AS h, count(*) AS d FROM c GROUP BY term) "
    "SELECT {key}, round(sum(n * CASE WHEN h = 0 THEN 0 WHEN h = d THEN log10(1.0001) ELSE log10(d / h) END ** 2), 6) AS r FROM c JOIN i USING (term) GROUP BY {key} HAVING {having}"
)
_NATURAL_TWIN = _RANK_TWIN.format(key="doc_id", words=_WORDS, table="documents", terms="['apache', 'license', 'mit', 'lizenz']", having="sum(n) > 0")
_TEXT = f"' ' || array_to_string({_WORDS}, ' ') || ' '"
_PHRASE_TWIN = f"SELECT doc_id, lang FROM documents WHERE contains({_TEXT}, ' public license ') OR contains({_TEXT}, ' apache license version ')"
_BOOLEAN_TWIN = f"SELECT doc_id FROM documents WHERE contains({_TEXT}, ' the ') AND NOT contains({_TEXT}, ' was ')"
_GROUPS_TWIN = (
    f"SELECT lang, count(*) AS n FROM documents WHERE doc_id < 3 OR (contains({_TEXT}, ' und ') OR contains({_TEXT}, ' the ')) AND (contains({_TEXT}, ' de ') OR contains({_TEXT}, ' of ')) AND NOT contains({_TEXT}, ' licen') GROUP BY lang"
)

# --- geometry -------------------------------------------------------------------

_POINT = "SDO_GEOMETRY(2001, NULL, SDO_POINT_TYPE({x}, {y}, NULL), NULL, NULL)"
_BOX = "SDO_GEOMETRY(2003, NULL, NULL, SDO_ELEM_INFO_ARRAY(1, 1003, 3), SDO_ORDINATE_ARRAY({a}, {b}, {c}, {d}))"
_CUSTOMER = _POINT.format(x="c_acctbal", y="c_custkey")
_FIELD = _BOX.format(a="s_acctbal", b="s_suppkey * 10", c="s_acctbal + 300", d="s_suppkey * 10 + 50")


def sdo_distance(spark, d):
    _views(spark, d, "customer")
    box = _BOX.format(a=0, b=0, c=1000, d=100)
    return query(spark, f"SELECT c_custkey, ROUND(SDO_GEOM.SDO_DISTANCE({_CUSTOMER}, {box}, 0.005), 4) AS d FROM customer", "oracle")


def sdo_within_distance(spark, d):
    _views(spark, d, "customer")
    box = _BOX.format(a=0, b=0, c=1000, d=100)
    return query(spark, f"SELECT c_custkey FROM customer WHERE SDO_WITHIN_DISTANCE({_CUSTOMER}, {box}, 'distance=250') = 'TRUE'", "oracle")


def sdo_relate_masks(spark, d):
    """Every supplier's box set beside one box."""
    _views(spark, d, "supplier")
    box = _BOX.format(a="s_acctbal - MOD(s_suppkey, 3) * 150", b="s_suppkey * 10", c="s_acctbal + 300 - MOD(s_suppkey, 2) * 150", d="s_suppkey * 10 + 25 * MOD(s_suppkey, 4)")
    boxes = f"(SELECT s_suppkey, {_FIELD} AS g, {box} AS h FROM supplier WHERE MOD(s_suppkey, 4) > 0)"
    masks = ("ANYINTERACT", "CONTAINS", "INSIDE", "COVERS", "COVEREDBY", "EQUAL", "TOUCH", "OVERLAPBDYINTERSECT")
    told = ", ".join(f"SDO_RELATE(g, h, 'mask={m}') AS {m.lower()}" for m in masks)
    return query(spark, f"SELECT s_suppkey, {told} FROM {boxes} b", "oracle")


def my_spatial_measures(spark, d):
    """Well-known text made from columns: area with a hole, length, envelope, parts of points."""
    _views(spark, d, "nation")
    shape = "CONCAT('POLYGON((0 0, ', n_nationkey + 4, ' 0, ', n_nationkey + 4, ' 6, 0 6, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))')"
    line = "CONCAT('LINESTRING(0 0, 3 4, 3 ', n_nationkey + 4, ')')"
    return query(
        spark,
        f"SELECT n_nationkey, ST_Area(ST_GeomFromText({shape})) AS area, ST_Length(ST_GeomFromText({line})) AS length, ST_Area(ST_Envelope(ST_GeomFromText({line}))) AS bounds, "
        f"ST_X(POINT(n_nationkey, 2)) AS x, ST_Contains(ST_GeomFromText({shape}), POINT(1.5, 1.5)) AS hole, ST_Within(POINT(n_nationkey, 3), ST_GeomFromText({shape})) AS inside, "
        f"ST_Touches(POINT(n_nationkey, 6), ST_GeomFromText({shape})) AS edge FROM nation",
        "mysql",
    )


def _points_and_boxes(spark, d):
    _views(spark, d, "customer", "supplier")
    geometry.register(spark, "geo_point geo_box")
    points = spark.sql("SELECT c_custkey, geo_point(c_acctbal, c_custkey) AS g FROM customer")
    wide = "IF(s_suppkey % 7 = 0, 4000, 300)"
    return points, spark.sql(f"SELECT s_suppkey, geo_box(s_acctbal, s_suppkey * 10, s_acctbal + {wide}, s_suppkey * 10 + {wide} / 6) AS g FROM supplier")


def spatial_join_inside(spark, d):
    points, boxes = _points_and_boxes(spark, d)
    return spatial.spatial_join(points, boxes, "g", "g", "coveredby").select("left.c_custkey", "right.s_suppkey")


def spatial_join_distance(spark, d):
    points, boxes = _points_and_boxes(spark, d)
    return spatial.spatial_join(points, boxes, "g", "g", distance=40).select("left.c_custkey", "right.s_suppkey")


_APART = "sqrt(greatest({a} - c_acctbal, c_acctbal - {c}, 0) ** 2 + greatest({b} - c_custkey, c_custkey - {d}, 0) ** 2)"
_JOIN_TWIN = (
    "SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT s_suppkey, s_acctbal AS a, s_suppkey * 10 AS b, s_acctbal + w AS c, s_suppkey * 10 + w / 6 AS d FROM (SELECT *, CASE WHEN s_suppkey % 7 = 0 THEN 4000 ELSE 300 END AS w FROM supplier)) "
    f"ON {_APART.format(a='a', b='b', c='c', d='d')} <= "
)


def _relate_twin() -> str:
    """Two boxes by their bounds: the second begins left of the first's side or on it, and ends inside or on it."""
    rel = "FROM (SELECT s_suppkey, s_acctbal AS ga, s_acctbal + 300 AS gc, s_acctbal - s_suppkey % 3 * 150 AS ha, s_acctbal + 300 - s_suppkey % 2 * 150 AS hc, s_suppkey * 10 AS lo, s_suppkey * 10 + 50 AS gd, s_suppkey * 10 + 25 * (s_suppkey % 4) AS hd FROM supplier WHERE s_suppkey % 4 > 0)"
    g_over_h, h_over_g = "ha >= ga AND hc <= gc AND hd <= gd", "ga >= ha AND gc <= hc AND gd <= hd"
    meets, apart = "true", "false"  # the two always share ground
    yes = lambda c: f"CASE WHEN {c} THEN 'TRUE' ELSE 'FALSE' END"
    masks = {"anyinteract": meets, "contains": g_over_h, "inside": h_over_g, "covers": g_over_h, "coveredby": h_over_g, "equal": f"{g_over_h} AND {h_over_g}", "touch": apart, "overlapbdyintersect": f"NOT ({g_over_h}) AND NOT ({h_over_g})"}
    return f"SELECT s_suppkey, {', '.join(f'{yes(c)} AS {m}' for m, c in masks.items())} {rel}"


# --- vectors --------------------------------------------------------------------


def vec_order_by_distance(spark, d):
    """Nearest vectors to one of the table's own, as MariaDB orders them."""
    _views(spark, d, "embeddings")
    return query(spark, "SELECT e.vec_id, ROUND(VEC_DISTANCE_COSINE(e.embedding, q.embedding), 5) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY VEC_DISTANCE_COSINE(e.embedding, q.embedding), e.vec_id LIMIT 20", "mysql")


def vec_distances(spark, d):
    _views(spark, d, "embeddings")
    q = "(SELECT embedding AS v FROM embeddings WHERE vec_id = 3) q"
    return query(spark, f"SELECT e.vec_id, ROUND(VECTOR_DISTANCE(e.embedding, q.v, EUCLIDEAN), 5) AS l2, ROUND(VECTOR_DISTANCE(e.embedding, q.v, DOT), 5) AS dot FROM embeddings e, {q}", "oracle")


def _index(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return vectors.build(rows, "vec_id", "embedding", "euclidean"), rows.where("vec_id % 50 = 0")


def vec_index_exact(spark, d):
    """The ten nearest of every fiftieth vector, over all cells."""
    index, asked = _index(spark, d)
    return index.search(asked, "vec_id", "embedding", 10).select("query", "neighbour", "place", F.round("distance", 5).alias("distance"))


def vec_index_recall(spark, d):
    """Of every fiftieth vector: true neighbours among the ten that a search of the fewest cells with a recall of 0.9 gives, summed up."""
    index, asked = _index(spark, d)
    path = os.path.join(shared_dir(spark), f"neighbours-{uuid.uuid4().hex}")
    index.search(asked, "vec_id", "embedding", 10).select("query", "neighbour").write.parquet(path)  # ten rows a query; read three times
    true = spark.read.parquet(path)
    found = index.search(asked, "vec_id", "embedding", 10, index.probes_for(asked, "vec_id", "embedding", 10, true=true))
    hits = true.join(found.select("query", "neighbour"), ["query", "neighbour"], "left_semi").count()
    return true.agg(F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.lit(hits) >= F.count(F.lit(1)) * 0.9).alias("reached"))


_L2 = "sqrt(list_sum([(CAST(z[1] AS DOUBLE) - z[2]) ** 2 for z in list_zip({a}, {b})]))"
_DOT = "list_sum([CAST(z[1] AS DOUBLE) * z[2] for z in list_zip({a}, {b})])"
_COSINE = f"1 - {_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')}))"

_QUERIES = (
    ft_natural_scan, ft_natural_index, ft_phrase_scan, ft_phrase_index, ft_boolean_index, ft_groups_index, ft_ddl_key,
    sdo_distance, sdo_within_distance, sdo_relate_masks, my_spatial_measures, spatial_join_inside, spatial_join_distance,
    vec_order_by_distance, vec_distances, vec_index_exact, vec_index_recall,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    box = _APART.format(a=0, b=0, c=1000, d=100)
    return {
        "ft_natural_scan": _NATURAL_TWIN,
        "ft_natural_index": _NATURAL_TWIN,
        "ft_phrase_scan": _PHRASE_TWIN,
        "ft_phrase_index": _PHRASE_TWIN,
        "ft_boolean_index": _BOOLEAN_TWIN,
        "ft_groups_index": _GROUPS_TWIN,
        "ft_ddl_key": _RANK_TWIN.format(key="p_partkey", words=r"regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}_]+')", table="part", terms="['brushed', 'tin']", having="sum(n) FILTER (WHERE term = 'brushed') > 0"),
        "sdo_distance": f"SELECT c_custkey, round({box}, 4) AS d FROM customer",
        "sdo_within_distance": f"SELECT c_custkey FROM customer WHERE {box} <= 250",
        "sdo_relate_masks": _relate_twin(),
        "my_spatial_measures": "SELECT n_nationkey, CAST((n_nationkey + 4) * 6 - 1 AS DOUBLE) AS area, CAST(5 + n_nationkey AS DOUBLE) AS length, CAST(3 * (n_nationkey + 4) AS DOUBLE) AS bounds, CAST(n_nationkey AS DOUBLE) AS x, false AS hole, n_nationkey > 0 AS inside, true AS edge FROM nation",
        "spatial_join_inside": _JOIN_TWIN + "0",
        "spatial_join_distance": _JOIN_TWIN + "40",
        "vec_order_by_distance": f"SELECT e.vec_id, round({_COSINE}, 5) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_COSINE}, e.vec_id LIMIT 20",
        "vec_distances": f"SELECT e.vec_id, round({_L2.format(a='e.embedding', b='q.v')}, 5) AS l2, round(-{_DOT.format(a='e.embedding', b='q.v')}, 5) AS dot FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 3) q",
        "vec_index_exact": f"SELECT query, neighbour, CAST(place AS INTEGER) AS place, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS place FROM (SELECT q.vec_id AS query, e.vec_id AS neighbour, {_L2.format(a='e.embedding', b='q.embedding')} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE place <= 10",
        "vec_index_recall": "SELECT count(*) AS queries, count(*) * 10 AS neighbours, true AS reached FROM embeddings WHERE vec_id % 50 = 0",
    }
