"""Places in an order without a task that holds all rows: rows are dealt in ranges of the order, counted, and numbered from where their range begins."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir


def placed(df: DataFrame, order: list[Column], column: str = "_place") -> tuple[DataFrame, int]:
    """(rows with their place from 0 on, how many there are). Without an order rows are numbered as they stand.

    Rows are sorted in ranges and written; one small job counts each range,
    and a range's start is the sum of those before it (a row a range is
    broadcast).  So the order is total over the table, ties fall as they were
    written, and no window spans more than a range.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    path = os.path.join(shared_dir(spark), f"placed-{uuid.uuid4().hex}")
    rows.withColumn("_seq", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    part = F.shiftright("_seq", 33)
    starts, at = [], 0
    for p, n in sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect()):  # a row a range
        starts.append((p, at))
        at += n
    if not starts:
        return kept.drop("_seq").withColumn(column, F.lit(0).cast("long")), 0
    table = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    inside = F.col("_seq") - F.shiftleft(part, 33)
    out = kept.withColumn("_part", part).join(table, "_part").withColumn(column, F.col("_start") + inside)
    return out.drop("_seq", "_part", "_start"), at


def between(df: DataFrame, order: list[Column], first: int, count: int, column: str = "_place") -> DataFrame:
    """The rows at `count` places of the order from `first` on."""
    rows, _ = placed(df, order, column)
    return rows.where((F.col(column) >= first) & (F.col(column) < first + count))
