"""The folder that the driver and all executors share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder under /tmp in local mode, which has one machine; on a cluster an error."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join("/tmp/checkpoints", sc.applicationId)
