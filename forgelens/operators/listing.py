"""Repository listing, file properties and commit activity."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registries as R
from ..functions import text as T
from .selection import blobs


def file_extensions(files: DataFrame) -> DataFrame:
    """Repo, path, size_bytes, extension of every file."""
    return blobs(files).select(
        "repo", "path", "size_bytes", T.extension(F.col("path")).alias("extension")
    )


def file_language(files: DataFrame) -> DataFrame:
    """Rule language by suffix."""
    return blobs(files).select("repo", "path", T.language(F.col("path")).alias("language"))


def file_sizes(files: DataFrame) -> DataFrame:
    """S3: characters of the decoded text."""
    return blobs(files).select(
        "repo", "path", F.length("content").cast("bigint").alias("size")
    )


def has_tests(files: DataFrame) -> DataFrame:
    """A path naming tests, among files only and among all entries."""
    named = F.lower("path").contains("test")
    return files.groupBy("repo").agg(
        F.coalesce(F.bool_or(F.when(F.col("kind") == "blob", named)), F.lit(False)).alias(
            "has_tests_folder"
        ),
        F.coalesce(F.bool_or(named), F.lit(False)).alias("has_test_entries"),
    )


def repo_structure(repos: DataFrame, files: DataFrame) -> DataFrame:
    """One row per repository; the file list itself is :func:`file_extensions`."""
    counts = files.groupBy("repo").agg(
        F.count_if(F.col("kind") == "blob").alias("total_files"),
        F.bool_or((F.col("kind") == "blob") & F.lower("path").contains("test")).alias("_tests"),
    )
    return repos.join(counts, "repo", "left").select(
        "repo",
        "default_branch",
        F.coalesce("total_files", F.lit(0)).cast("bigint").alias("total_files"),
        F.coalesce("_tests", F.lit(False)).alias("has_tests_folder"),
        "stars",
        "language",
    )


def capped_count(cap: int | None) -> Column:
    n = F.count("*")
    return (n if cap is None else F.least(n, F.lit(cap))).cast("bigint")


def commit_activity(commits: DataFrame, sample_cap: int | None = None) -> DataFrame:
    """Newest commit and the number of commits, per repository.

    Dates and counts are aggregated by hash; only the commits of the newest date
    are then looked at for their message (the greatest ``sha`` of equal dates).
    """
    newest = commits.groupBy("repo").agg(
        F.max("author_date").alias("last_commit_date"), capped_count(sample_cap).alias("sample_size")
    )
    last = commits.join(
        newest.select("repo", F.col("last_commit_date").alias("author_date")), ["repo", "author_date"]
    )
    messages = last.groupBy("repo").agg(F.max_by("message", "sha").alias("last_commit_message"))
    return newest.join(messages, "repo", "left").select(
        "repo", "last_commit_date", "last_commit_message", "sample_size"
    )


def dependency_file(files: DataFrame, order=None, with_content: bool = False) -> DataFrame:
    """The first root-level dependency file in the given order.

    The path filter reaches the scan, so only the few candidates are read.
    """
    names = F.array(*[F.lit(n) for n in order or R.DEPENDENCY_FILES_SCAN])
    rank = F.array_position(names, F.col("path"))
    # the least rank instead of the path itself keeps the aggregation hash-based
    best = [F.min(rank).alias("_rank")]
    if with_content:
        best.append(F.min_by("content", rank).alias("content"))
    candidates = blobs(files).where(F.col("path").isin(order or R.DEPENDENCY_FILES_SCAN))
    return (
        candidates.groupBy("repo")
        .agg(*best)
        .withColumn("filename", F.element_at(names, F.col("_rank").cast("int")))
        .drop("_rank")
    )


def repo_scan(repos: DataFrame, files: DataFrame, commits: DataFrame) -> DataFrame:
    """Structure, dependency file and activity in one row per repository."""
    return (
        repo_structure(repos, files)
        .join(dependency_file(files), "repo", "left")
        .join(commit_activity(commits), "repo", "left")
        .withColumnRenamed("filename", "dependency_file")
        .withColumn("sample_size", F.coalesce("sample_size", F.lit(0).cast("bigint")))
    )


def file_churn(
    commits: DataFrame, as_of, days: int = 90, commit_cap: int | None = None
) -> DataFrame:
    """Commits per file in the window before ``as_of``; with a cap they saturate."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = commits.where(F.col("author_date").between(start, end))
    return recent.groupBy("repo", "path").agg(
        capped_count(commit_cap).alias("commit_count"),
        F.max("author_date").alias("last_modified"),
    )


def churn_history(
    commits: DataFrame, first, n_dates: int, step_days: int = 1, days: int = 90, commit_cap: int | None = None
) -> DataFrame:
    """S6 at many dates: (repo, path, as_of, commit_count, last_modified), in one pass.

    The dates are ``first`` and the ``n_dates - 1`` that follow it in steps of whole days.
    Each row is what :func:`file_churn` gives for its date, both ends of the window
    included; a file without commits in a window has no row for it.

    A commit is counted in the dates from the first one not before it to the last one
    whose window it is in: a file keeps one number per date at which something enters or
    leaves, whatever its number of commits, and running sums of these give every date.
    Commits without a date do not count; no dates, no rows.
    """
    start = F.lit(first).cast("timestamp_ntz")
    date = F.col("author_date").cast("timestamp_ntz")
    # days since the first date, and whether a commit stands between two days' ends
    shifted = date - (start - F.date_trunc("day", start).cast("timestamp_ntz"))
    whole = F.datediff(shifted.cast("date"), start.cast("date"))
    between = shifted > shifted.cast("date").cast("timestamp_ntz")
    half_days = (2 * whole + between.cast("int")).cast("bigint")
    entered = F.greatest(F.ceil(half_days / (2 * step_days)), F.lit(0))
    left = F.floor((half_days + 2 * days) / (2 * step_days)) + 1
    counted = commits.where("author_date IS NOT NULL").select(
        "repo", "path", "author_date", entered.cast("int").alias("_in"), F.least(left, F.lit(n_dates)).cast("int").alias("_out")
    ).where("_in < _out")
    change = lambda at, n, seen: F.struct(F.col(at).alias("at"), F.lit(n).alias("n"), seen.alias("seen"))
    none = F.lit(None).cast(commits.schema["author_date"].dataType)
    changes = counted.select(
        "repo", "path", F.inline(F.array(change("_in", 1, F.col("author_date")), change("_out", -1, none)))
    )
    per_date = changes.groupBy("repo", "path", "at").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"))
    order = Window.partitionBy("repo", "path").orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = per_date.select(
        "repo",
        "path",
        "at",
        F.sum("n").over(running).alias("n"),
        F.max("seen").over(running).alias("last_modified"),
        F.lead("at").over(order).alias("until"),
    ).where("n > 0")
    number = F.col("n") if commit_cap is None else F.least("n", F.lit(commit_cap))
    return spans.select(
        "repo", "path", number.cast("bigint").alias("commit_count"), "last_modified",
        F.explode(F.sequence("at", F.col("until") - 1)).alias("_date"),
    ).select(
        "repo", "path", (start + F.make_dt_interval(F.col("_date") * step_days)).alias("as_of"),
        "commit_count", "last_modified",
    )
