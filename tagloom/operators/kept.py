"""Tables that several branches of a plan read, or that a later step must find unchanged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which all executors share.

    Where the session names none (``spark.checkpoint.dir``), a session in local mode gets a folder of this machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """The frame, written to the shared folder and read back; in files of at most ``file_rows`` rows, if given."""
    spark = df.sparkSession
    path = shared_path(spark, "kept")
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
