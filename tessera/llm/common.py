"""What the operators share: words, scratch tables in the shared folder, labelled samples."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty.

    bytes.split() and bytes.lower() work on ASCII alone, which is the word and
    the lower-casing that the operators want.
    """
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: Rows that a function in Python sees at a time: Spark's batches hold 10,000, whose texts need not all be objects at once.
ROWS = 512


def tidy() -> None:
    """Gives memory that is free in this worker back to the machine: workers outlive their tasks and stand beside the JVM in an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a function from one record batch to one record batch (or None); it sees ROWS rows at a time."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                out = fn(batch.slice(i, ROWS))
                if out is not None:
                    yield out
        tidy()

    return df.mapInArrow(run, schema)


def arrow_column(fn, kind):
    """A column function of an Arrow array, ROWS rows at a time; the rest of a row stays in the JVM."""

    def run(column: pa.Array) -> pa.Array:
        parts = [fn(column.slice(i, ROWS)) for i in range(0, max(len(column), 1), ROWS)]
        whole = pa.concat_arrays(parts)
        del parts
        tidy()
        return whole

    return F.arrow_udf(run, kind)


def in_fold(id_col: str, folds: int):
    """True where crc32(id as text) mod folds is 0; a row without an id is in no such fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_ids(labels: DataFrame, columns: list[str], bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most about `bound` labelled ids, the same ones in any run: those whose hash falls lowest.

    Rows without an id or with a null in a label are left out; of repeated
    ids the largest label counts.
    """
    known = labels.where(F.col(id_col).isNotNull())
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    known = known.groupBy(id_col).agg(*[F.max(c).cast("double").alias(c) for c in columns])
    total = known.count()
    if total > bound:
        parts = 1 << 48
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) < bound * parts // total)
    return known


def joined_by_weight(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, total: int, shares: int = 1000) -> DataFrame:
    """Inner join of rows with one row of values a key (null equals null), where no key fills a task.

    `weight` says how many of the `total` rows hold the key.  Keys held by at
    least one row in `shares` are at most `shares` (for each value of a key
    column that rows are exploded over), so these are broadcast and their rows
    stay where they are; all others meet in a shuffled join.
    """
    heavy = F.col(weight) * shares >= total
    slim = [F.col(k).alias(f"_{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rest = [c for c in values.columns if c not in (*keys, weight)]
    hot = F.broadcast(values.where(heavy).select(*slim, *rest))
    cold = values.where(~heavy).select(*slim, *rest).hint("shuffle_merge")
    near = rows.join(hot, same)
    far = rows.join(hot.select(*[f"_{k}" for k in keys]), same, "left_anti").join(cold, same)
    return near.unionByName(far).drop(*[f"_{k}" for k in keys])
