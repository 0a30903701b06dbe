"""Repository trees and tables as input."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# a pair of non-characters stands in for a genuine U+FFFD while bytes are repaired
_REPLACEMENT, _STAND_IN = "\ufffd", "\ufdd0\ufdd1"


def decode_text(content: Column) -> Column:
    """S3: UTF-8 text of a binary column with invalid bytes dropped."""
    text = content.cast("string")
    kept = F.replace(text, F.lit(_REPLACEMENT), F.lit(_STAND_IN))
    repaired = F.replace(F.make_valid_utf8(kept), F.lit(_REPLACEMENT), F.lit(""))
    restored = F.replace(repaired, F.lit(_STAND_IN), F.lit(_REPLACEMENT))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as file paths show it: with scheme, absolute, without a last slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def read_trees(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``files`` from checked-out trees laid out as ``root/<owner>/<repo>/<path>``.

    ``glob`` (such as ``*.py``) limits the files before any of them is opened;
    contents are read only if ``content`` is used.  A file that lies in no repository
    (directly below the root or an owner) is left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select(
        F.col("path").alias("file"),
        F.lit("blob").alias("kind"),
        F.col("length").alias("size_bytes"),
        decode_text(F.col("content")).alias("content"),
    )
    return _placed(spark, files, root, "file", ["kind", "size_bytes", "content"])


def _placed(spark: SparkSession, files: DataFrame, root: str, file: str, columns: list[str]) -> DataFrame:
    """(repo, path) from the location of a file below the root, and the columns."""
    below = F.substring(F.col(file), F.lit(len(_qualified(spark, root)) + 2), F.length(file))
    parts = F.split(below, "/", 3)
    return files.where(F.size(parts) == 3).select(
        F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("repo"),
        F.get(parts, F.lit(2)).alias("path"),
        *columns,
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The ``files`` table from Parquet."""
    return spark.read.schema(schemas.FILES).parquet(path)


def read_commits(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The ``commits`` table from Parquet or JSON lines."""
    return spark.read.schema(schemas.COMMITS).format(file_format).load(path)
