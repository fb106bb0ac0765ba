"""Spatial joins: geometries meet in the cells of a grid of many sizes, then an exact predicate decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

#: Relations of the left geometry to the right one, as SQL over both.
RELATIONS = {
    "intersects": "geo_intersects({g}, {h})",
    "contains": "geo_contains({g}, {h})",
    "covers": "geo_covers({g}, {h})",
    "inside": "geo_contains({h}, {g})",
    "coveredby": "geo_covers({h}, {g})",
    "touches": "geo_touches({g}, {h})",
    "overlaps": "geo_overlaps({g}, {h})",
    "equals": "geo_equals({g}, {h})",
}


def _sized(df: DataFrame, geom: str, margin: float, side: str) -> DataFrame:
    """Rows with a geometry, as a struct, their bounds widened by a margin, and their level: cells of 2^level are at least as wide as the bounds."""
    b = F.expr(f"geo_bounds(`{geom}`)")
    rows = df.where(F.col(geom).isNotNull()).select(F.struct("*").alias(side), b.alias("b"))
    ax, ay, bx, by = (F.col("b")["ax"] - margin, F.col("b")["ay"] - margin, F.col("b")["bx"] + margin, F.col("b")["by"] + margin)
    wide = F.greatest(bx - ax, by - ay)
    level = F.when(wide > 0, F.ceil(F.log2(wide)).cast("int"))
    return rows.select(side, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), level.alias("level"))


def _cells(df: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each cell that the bounds meet at the row's own level (four at most) and at every coarser level in use."""
    size = F.pow(F.lit(2.0), F.col("at"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))
    df = df.withColumn("at", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("level"))))
    return df.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, relation: str = "intersects", distance: float | None = None) -> DataFrame:
    """Pairs of rows as structs `left` and `right` whose geometries stand in a relation, or lie within a distance of each other.

    Every geometry lies in at most four cells of its own level, whatever its
    size, and in at most four of each coarser level that some row uses; a pair
    meets at the coarser of its two levels, in the one cell that holds the
    lower corner of their common bounds.  So the join is an equality of
    (level, cell), each pair is tested once, and no two rows meet that are
    further apart than a few of their own widths.  Points have the finest
    level in use.  Rows without a geometry are in no pair.  Where many rows
    share a cell Spark splits its partition (adaptive skew join); all pairs
    that hold are the result, however many.
    """
    spark = left.sparkSession
    margin = (distance or 0.0) / 2
    test = f"geo_distance({{g}}, {{h}}) <= {float(distance)!r}D" if distance is not None else RELATIONS[relation]
    test = test.format(g=f"a.left.`{left_geom}`", h=f"b.right.`{right_geom}`")
    geometry.register(spark, "geo_bounds " + test)
    a, b = _sized(left, left_geom, margin, "left"), _sized(right, right_geom, margin, "right")
    seen = [r[0] for r in a.select("level").unionByName(b.select("level")).distinct().collect()]  # at most 2,100: exponents of doubles
    levels = sorted({v for v in seen if v is not None}) or [0]
    a, b = (_cells(df.fillna({"level": levels[0]}), levels) for df in (a, b))
    coarse = F.greatest(F.col("a.level"), F.col("b.level"))
    size = F.pow(F.lit(2.0), coarse)
    home = lambda k: F.floor(F.greatest(F.col(f"a.{k}"), F.col(f"b.{k}")) / size)
    met = (F.col("a.bx") >= F.col("b.ax")) & (F.col("b.bx") >= F.col("a.ax")) & (F.col("a.by") >= F.col("b.ay")) & (F.col("b.by") >= F.col("a.ay"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("at", "cx", "cy")]
    once = (F.col("a.at") == coarse) & (F.col("a.cx") == home("ax")) & (F.col("a.cy") == home("ay"))
    # one condition, so that the exact test stands behind the cheap ones
    return a.alias("a").join(b.alias("b"), [*same, F.when(met & once, F.expr(test)).otherwise(False)]).select(F.col("a.left").alias("left"), F.col("b.right").alias("right"))
