"""Checkpoints, and folders for files, in the place that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset, which must not lie on one machine of a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local") and warehouse.partition(":")[0] in (warehouse, "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"{warehouse}/_checkpoints"
    return folder


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    return f"{shared(spark).rstrip('/')}/files/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written once in the shared place, so that it is neither planned nor computed again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
