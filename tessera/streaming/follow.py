"""A rerunnable copy of files as they arrive: each micro-batch is one batch of the target, replaced if it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.copy import BATCH, coerced


def follow(spark: SparkSession, source: str, target: str, columns: dict[str, str], checkpoint: str, schema=None) -> int:
    """Copies what has arrived under `source` since the last call and returns the number of new rows.

    The checkpoint remembers which files are done. Rows are partitioned by micro-batch and overwritten by partition, so
    a batch that is run again after a failure replaces itself.
    """
    schema = schema or spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    counted = []

    def write(df: DataFrame, batch: int) -> None:
        out = coerced(df, columns).withColumn(BATCH, F.lit(batch).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(target)
        counted.append(spark.read.parquet(target).where(F.col(BATCH) == batch).count())

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(counted)
