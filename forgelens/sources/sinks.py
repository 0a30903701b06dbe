"""Results as tables and Markdown reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(lines: DataFrame, path: str, rows_per_file: int = 1 << 20) -> DataFrame:
    """Report lines (repo, place, text) in files of bounded size, and their index.

    Lines are dealt by ranges of (repo, place) and sorted, so that a report stands in one
    file or in neighbouring ones, however many reports or lines there are; no file or
    folder is made for a repository.  Returns and writes the index: repo, file, n_lines.
    """
    folder = f"{path.rstrip('/')}/lines"
    lines.select("repo", "place", "text").repartitionByRange("repo", "place").sortWithinPartitions(
        "repo", "place"
    ).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    spark = lines.sparkSession
    index = spark.read.parquet(folder).groupBy("repo", F.col("_metadata.file_name").alias("file"))
    index.agg(F.count("*").alias("n_lines")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/index")
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def read_report(spark: SparkSession, path: str, repo: str) -> str | None:
    """The text of one report, from the files its index names; None if there is none."""
    root = path.rstrip("/")
    found = spark.read.parquet(f"{root}/index").where(F.col("repo") == repo).select("file").collect()
    if not found:
        return None
    lines = spark.read.parquet(*[f"{root}/lines/{r['file']}" for r in found]).where(F.col("repo") == repo)
    return "".join(r["text"] + "\n" for r in lines.orderBy("place").select("text").collect())


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each result table as Parquet under its name."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
