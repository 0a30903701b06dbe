"""Writes an intermediate result once where several branches of a query need it."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; only a local session makes its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="forgelens-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back.

    The branches that use it then read columns of a table instead of repeating
    the scan behind it, and a lost executor costs a re-read only.  The write is a
    job of its own, run when this is called.
    """
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
