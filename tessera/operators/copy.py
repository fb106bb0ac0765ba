"""Copying a table: pruned columns, coerced values, batches that can be replayed, validation."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerce, lost
from .ranges import WIDTH, batch_of, batches_together

BATCH = "_batch"
#: Neighbouring batches that lie in one folder, where a folder for each would be too many.
GROUP = "_group"
#: Where a copy keeps its plan, below the table's path; readers of the table skip names that begin so.
PLAN = "_plan"


@dataclass
class CopyResult:
    path: str
    rows: int
    lost: dict[str, int]  # values that became NULL, by column


def coerced(df: DataFrame, target: dict[str, str]) -> DataFrame:
    """The columns of `target` (name: Spark type), coerced; other columns of df are not read."""
    by = {c.lower(): c for c in df.columns}
    cols = []
    for name, kind in target.items():
        src = by.get(name.lower())
        cols.append(F.lit(None).cast(kind).alias(name) if src is None else coerce(F.col(f"`{src}`"), df.schema[src].dataType, kind).alias(name))
    return df.select(*cols)


def copy_table(df: DataFrame, path: str, target: dict[str, str], key: str | None = None, width: int = WIDTH, only: list[int] | None = None) -> CopyResult:
    """Writes a table in one job, which also counts its rows and losses.

    With a key, rows are partitioned by batch number, which is the key by the
    width asked for, counted from 0.  The first copy keeps the width beside
    the data, so a replay (`only`: batch numbers) means the same keys whatever
    has arrived meanwhile, and dynamic overwrite replaces just those batches.
    Where the keys make more than 10,000 batches, neighbouring ones lie in one
    folder: a replay writes the folders of its batches anew, with the other
    batches' rows as they stand there.  Without `only` the whole table is
    replaced.
    """
    spark = df.sparkSession
    by = {c.lower(): c for c in df.columns}
    if key is not None:
        if only is not None:
            plan = spark.read.parquet(f"{path}/{PLAN}").first()
            width, together = plan.width, plan.together
            df = df.where(batch_of(F.col(key), width).isin(only))
        else:
            together = batches_together(*df.agg(F.min(key), F.max(key)).first(), width)
    known = {n: by[n.lower()] for n in target if n.lower() in by}
    losses = [F.coalesce(F.sum(lost(F.col(f"`{c}`"), coerce(F.col(f"`{c}`"), df.schema[c].dataType, target[n]))), F.lit(0)).alias(f"lost_{n}") for n, c in known.items()]
    seen = Observation()
    df = df.select(*dict.fromkeys([*known.values(), *([by[key.lower()]] if key else [])])).observe(seen, F.count(F.lit(1)).alias("rows"), *losses)
    if key is None:
        coerced(df, target).write.mode("overwrite").parquet(path)
    else:
        cols = [F.col(c) for c in target]
        own = coerced(df.withColumn(BATCH, batch_of(F.col(key), width)), target | {BATCH: "bigint"}).select(*cols, BATCH)
        folder = BATCH
        if together > 1:
            folder, own = GROUP, own.withColumn(GROUP, F.floor(F.col(BATCH) / together).cast("long"))
            if only is not None:  # the folders' other batches stay; dynamic overwrite takes the old files away when all new ones are written
                beside = spark.read.schema(own.schema).parquet(path).where(F.col(GROUP).isin(sorted({b // together for b in only})) & ~F.col(BATCH).isin(only))
                own = own.unionByName(beside)
        own = own.hint("rebalance", folder)  # a folder is a few files, not one of every task
        mode = "static" if only is None else "dynamic"
        own.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(folder).parquet(path)
        if only is None:
            spark.createDataFrame([(key, width, together)], "key string, width long, together long").coalesce(1).write.mode("overwrite").parquet(f"{path}/{PLAN}")
    try:
        got = seen.get
    except Py4JJavaError:  # a plan that is empty from the start runs no job that could be observed
        got = {}
    return CopyResult(path, got.get("rows", 0), {n: got[f"lost_{n}"] for n in known if got.get(f"lost_{n}")})


def validate(source: DataFrame, target: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: counts of both sides and a checksum that ignores order, each computed in one pass."""
    cols = columns or [c for c in source.columns if c in target.columns]

    def side(df, name):
        h = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in cols]).cast("decimal(38,0)")
        return df.select(F.lit(name).alias("side"), h.alias("h"))

    both = side(source, "s").unionAll(side(target, "t"))
    own = lambda s, e: F.sum(F.when(F.col("side") == s, e))
    got = both.agg(own("s", F.lit(1)).alias("source_rows"), own("t", F.lit(1)).alias("target_rows"), own("s", F.col("h")).alias("a"), own("t", F.col("h")).alias("b"))
    got = got.select(F.coalesce("source_rows", F.lit(0)).cast("long").alias("source_rows"), F.coalesce("target_rows", F.lit(0)).cast("long").alias("target_rows"), F.col("a").eqNullSafe(F.col("b")).alias("same_values"))
    return got.withColumn("same_rows", F.col("source_rows") == F.col("target_rows"))


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    """A copied table without its batch numbers."""
    return spark.read.parquet(path).drop(BATCH, GROUP)
