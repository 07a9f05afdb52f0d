"""The folder that the driver and all executors share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all run on one machine, a folder of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file:///tmp/checkpoints/bucketlane"
    os.makedirs(own.removeprefix("file://"), exist_ok=True)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: the data and not the lineage survive a lost executor."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)
