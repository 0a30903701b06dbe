"""Which files of a repository an analysis covers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registries as R
from ..functions import text as T


def secret_candidate(path: Column) -> Column:
    """Python sources outside tests, virtual environments and vendored code."""
    return T.ends_with_any(path, R.SECRET_EXTENSIONS) & _own_source(path)


def deep_candidate(path: Column) -> Column:
    """Sources of any supported language, vendored modules excluded."""
    return (
        T.ends_with_any(path, R.DEEP_EXTENSIONS)
        & _own_source(path)
        & ~path.contains("node_modules")
    )


def _own_source(path: Column) -> Column:
    return (
        ~F.lower(path).contains("test") & ~path.contains(".venv") & ~path.contains("vendor")
    )


def blobs(files: DataFrame) -> DataFrame:
    return files.where("kind = 'blob'")


def flagged(files: DataFrame) -> DataFrame:
    """The files of either scan with a flag for each: for_secrets, for_deep."""
    path = F.col("path")
    flags = {"for_secrets": secret_candidate(path), "for_deep": deep_candidate(path)}
    return blobs(files).withColumns(flags).where("for_secrets OR for_deep")


def first_files(files: DataFrame, condition: Column, max_files: int) -> DataFrame:
    """The ``max_files`` files nearest to the root per repository, with rank.

    The rank limit is applied before the shuffle as well as after it, so a
    large repository sends at most ``max_files`` rows per task.
    """
    order = Window.partitionBy("repo").orderBy(T.depth(F.col("path")), "path")
    return (
        blobs(files)
        .where(condition)
        .select("repo", "path", F.row_number().over(order).alias("rn"))
        .where(F.col("rn") <= max_files)
    )


def candidates(files: DataFrame, condition: Column, max_files: int | None) -> DataFrame:
    """(repo, path) of the files under the condition; with a number, the first so many."""
    if max_files is not None:
        return first_files(files, condition, max_files)
    return blobs(files).where(condition).select("repo", "path")


def secret_candidates(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """L2: candidates of the secret scan, with rank ``rn`` if limited."""
    return candidates(files, secret_candidate(F.col("path")), max_files)


def deep_candidates(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """L2: candidates of the deep scan, with rank ``rn`` if limited."""
    return candidates(files, deep_candidate(F.col("path")), max_files)


def select_files(
    files: DataFrame,
    condition: Column,
    max_files: int | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """The files to analyse, chosen on narrow columns before content is read.

    ``paths(repo, path, pos)`` overrides the condition for the repositories it
    names, in the order of ``pos``.  Without ``max_files`` nothing is cut.
    """
    if paths is None:
        if max_files is None:
            return blobs(files).where(condition)
        chosen = first_files(files, condition, max_files)
        return files.join(chosen, ["repo", "path"], "left_semi")

    listed = paths
    if max_files is not None:
        order = Window.partitionBy("repo").orderBy("pos")
        listed = paths.withColumn("_n", F.row_number().over(order)).where(
            F.col("_n") <= max_files
        )
    named = paths.select("repo").distinct()
    explicit = files.join(listed, ["repo", "path"], "left_semi")
    automatic = select_files(files.join(named, "repo", "left_anti"), condition, max_files)
    return explicit.unionByName(automatic)


def analyst_selection(files: DataFrame, max_files: int = 4) -> DataFrame:
    """The largest Python files, without package markers, configuration and tests."""
    path = F.col("path")
    name = F.lower(F.substring_index(path, "/", -1))
    central = (
        path.endswith(".py")
        & ~path.endswith("__init__.py")
        & ~name.contains("config")
        & ~F.lower(path).contains("test")
    )
    order = Window.partitionBy("repo").orderBy(F.desc("size_bytes"), "path")
    return (
        blobs(files)
        .where(central)
        .select("repo", "path", F.row_number().over(order).alias("rn"))
        .where(F.col("rn") <= max_files)
    )
