"""Files too large for one row, as pieces of whole lines."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _placed, decode_text

LONG_FILE = 256 << 20  # bytes above which a file is read in pieces
PIECE = 1 << 18  # characters of a piece, its last line excepted


def read_long_files(
    spark: SparkSession, root: str, larger_than: int = LONG_FILE, glob: str | None = None
) -> DataFrame:
    """(repo, path, block, part, content): files of ``read_trees``' layout in pieces.

    Only files of more than ``larger_than`` bytes, for which the others are
    ``read_trees(…).where(size_bytes <= larger_than)``.  Spark splits a file at any byte
    and deals whole lines to one split; ``block`` is where the split starts, ``part``
    numbers its pieces.  A piece holds consecutive lines, each with its line feed, and is
    decoded like a whole file, but for a byte order mark, which is left out.  No task
    holds more than a batch of lines; one line must fit a row.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(root).where(F.col("_metadata.file_size") > larger_than)
    lines = lines.select(
        _plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        decode_text(F.col("value").cast("binary")).alias("line"),
    )
    pieces = lines.mapInArrow(_joined(PIECE), "file string, block bigint, part bigint, content string")
    return _placed(spark, pieces, root, "file", ["block", "part", "content"])


def _plain_path(uri: Column) -> Column:
    """A file's URI as Hadoop writes paths: nothing encoded, one slash after ``file:``."""
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def _joined(size: int):
    """Joins lines that follow each other in a split."""

    def join(batches):
        at, part, held, length = None, 0, [], 0

        def piece():
            columns = [[at[0]], [at[1]], [part], ["".join(held)]]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["file", "block", "part", "content"]
            )

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((file, block) != at or length >= size):
                    yield piece()
                    part, held, length = part + 1, [], 0
                if (file, block) != at:
                    at, part = (file, block), 0
                held.append(line + "\n")
                length += len(line) + 1
        if held:
            yield piece()

    return join
