"""Tables that end a plan's growth in loops: written to the shared checkpoint folder, so lost executors cost no earlier step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share. Where none is set a local one is taken, if all tasks run in this process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="voltaic-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written and read again."""
    path = f"{folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
