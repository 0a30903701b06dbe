"""Content scans over files as they arrive.

The scans are stateless projections, so the batch operators take a streaming
``files`` table as it is; this module only connects source and sink.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import scans
from ..operators.selection import flagged


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet parts of a ``files`` table as a stream."""
    reader = spark.readStream.schema(schemas.FILES)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_new_files(files: DataFrame, out_path: str, checkpoint: str, kinds=scans.ALL_KINDS):
    """Appends the hits of new files to a Parquet table, exactly once; ends when caught up."""
    return (
        scans.scan_files(flagged(files), kinds, applies=scans.applies_by_flag(kinds))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out_path)
    )
