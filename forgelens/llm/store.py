"""Tables written once to the folder that the cluster shares, and read back."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster
    without it is an error, as executors do not see each other's disks.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="forgelens-llm-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(frame: DataFrame, name: str, **options) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back from there.

    What is built on it starts from files that outlive any executor, and its
    lineage ends here.
    """
    path = shared_path(frame.sparkSession, name)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Python gets Arrow batches of so many rows at most, whatever the session says.

    For a table of whole texts that is written inside: by default a batch has 10,000 rows,
    and both the executor and its Python workers hold it whole.
    """
    before = spark.conf.get(BATCH_ROWS)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 1 << 20


def small_side(frame: DataFrame) -> DataFrame:
    """Marks a written table of a few numbers a row for broadcast if it is small enough.

    Meant for tables with a row per task or file; a larger one is joined by shuffle.
    """
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame
