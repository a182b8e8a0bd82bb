"""Cutting lineage: what is read more than once, or grows round by round, is written to the checkpoint folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session of one machine that names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a session on one machine may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written where the loss of executors does no harm."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()
