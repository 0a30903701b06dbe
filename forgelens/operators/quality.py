"""Code quality of Python files: sizes, markers, functions, documentation, grids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registries as R
from ..functions.pyblocks import python_blocks

LONG_FUNCTION, COMPLEX_FUNCTION = 50, 10


def marker_counts(content: Column) -> dict[str, Column]:
    """Q1: case-sensitive, non-overlapping occurrences of each marker."""
    return {
        marker.lower(): F.regexp_count(content, F.lit(marker)).cast("bigint")
        for marker in R.TODO_MARKERS
    }


def todo_counts(files: DataFrame) -> DataFrame:
    counts = marker_counts(F.col("content"))
    return (
        files.select("repo", "path", *[c.alias(n) for n, c in counts.items()])
        .withColumn("total", sum((F.col(n) for n in counts), F.lit(0).cast("bigint")))
    )


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file: size, markers, parse error and blocks as an array.

    The content goes to the Python worker once and is dropped afterwards; the
    blocks of a file stay in its row, so per-file statistics need no shuffle.
    """
    content = F.col("content")
    counts = marker_counts(content)
    return (
        files.select(
            "repo",
            "path",
            F.length(content).cast("bigint").alias("size"),
            *[c.alias(n) for n, c in counts.items()],
            python_blocks(content).alias("_parsed"),
        )
        .withColumns({"error": F.col("_parsed.error"), "blocks": F.col("_parsed.blocks")})
        .drop("_parsed")
    )


def _functions_of() -> Column:
    return F.filter("blocks", lambda b: b["kind"] != "class")


def _blocks_of() -> Column:
    return F.filter("blocks", lambda b: b["kind"] != "nested")


# Blocks are inlined through an array expression, here and below: for a bare
# column Spark infers a filter on its size and pushes it down to the scan, where
# the sources would be parsed a second time.


def functions(parsed: DataFrame) -> DataFrame:
    """Every block as a row."""
    every = F.filter("blocks", lambda b: b["name"].isNotNull())
    return parsed.select("repo", "path", F.inline(every))


def long_functions(parsed: DataFrame, threshold: int = LONG_FUNCTION) -> DataFrame:
    """Q3: functions, nested ones included, longer than the threshold."""
    found = F.filter(_functions_of(), lambda b: b["length"] > threshold)
    return parsed.select("repo", "path", F.inline(found)).select(
        "repo", "path", "name", F.col("length").alias("lines"), "lineno"
    )


def complex_functions(parsed: DataFrame, threshold: int = COMPLEX_FUNCTION) -> DataFrame:
    """Q4: blocks more complex than the threshold."""
    found = F.filter(_blocks_of(), lambda b: b["complexity"] > threshold)
    return parsed.select("repo", "path", F.inline(found)).select(
        "repo", "path", "name", "complexity", "lineno"
    )


def documentation_columns() -> dict[str, Column]:
    """Q2: null ratio without functions, null counts for a file that does not parse."""
    found = _functions_of()
    total = F.size(found)
    documented = F.size(F.filter(found, lambda b: b["has_docstring"]))
    parses = F.col("error").isNull()
    return {
        "total_functions": F.when(parses, total.cast("bigint")),
        "documented_functions": F.when(parses, documented.cast("bigint")),
        "documentation_ratio": F.when(
            parses & (total > 0), F.bround(documented / total * 100, 1)
        ),
    }


def documentation_ratio(parsed: DataFrame) -> DataFrame:
    columns = documentation_columns()
    return parsed.select(
        "repo", "path", *[c.alias(n) for n, c in columns.items()],
        F.col("error").isNotNull().alias("has_error"),
    )


def most_complex() -> Column:
    """The first block among those of the highest complexity."""
    ranked = F.transform(
        _blocks_of(),
        lambda b: F.struct(
            (-b["complexity"]).alias("order"), b["block_pos"].alias("position"), b.alias("block")
        ),
    )
    return F.array_min(ranked)["block"]


def complexity_columns() -> list[Column]:
    """Of ``_top``, the most complex block."""
    return [
        F.coalesce("_top.complexity", F.lit(1)).alias("max_complexity"),
        F.col("_top.name").alias("function_name"),
        F.col("_top.lineno").alias("function_lineno"),
    ]


def max_complexity(parsed: DataFrame) -> DataFrame:
    """Q5: 1 and no function for a file without blocks or with a syntax error."""
    return parsed.withColumn("_top", most_complex()).select("repo", "path", *complexity_columns())


def file_quality(parsed: DataFrame) -> DataFrame:
    """The four metrics of each file side by side; map-only."""
    return parsed.select("repo", "path", *file_quality_columns())


def file_metrics(parsed: DataFrame) -> DataFrame:
    """S8 and Q5 of each file from one row, so that a file is parsed once; map-only."""
    return parsed.withColumn("_top", most_complex()).select(
        "repo", "path", *file_quality_columns(), *complexity_columns()
    )


def file_quality_columns() -> list[Column]:
    long_ones = F.filter(_functions_of(), lambda b: b["length"] > LONG_FUNCTION)
    complex_ones = F.filter(_blocks_of(), lambda b: b["complexity"] > COMPLEX_FUNCTION)
    parses = F.col("error").isNull()
    marker_total = sum((F.col(m.lower()) for m in R.TODO_MARKERS), F.lit(0).cast("bigint"))
    return [
        F.col("size"),
        F.when(parses, F.size(long_ones).cast("bigint")).alias("n_long_functions"),
        F.when(parses, F.size(complex_ones).cast("bigint")).alias("n_complex_functions"),
        marker_total.alias("todo_total"),
        documentation_columns()["documentation_ratio"].alias("documentation_ratio"),
        F.col("error").isNotNull().alias("has_error"),
    ]


# The two severity grids.  A rule is
# (smell type, lower bound exclusive, severity); the first that applies wins.
README_GRID = {
    "cyclomatic_complexity": [(15, "CRITICAL"), (10, "MAJOR")],
    "long_function": [(50, "MAJOR")],
    "duplication": [(80, "CRITICAL"), (60, "MAJOR")],
    "low_documentation": [(30, "MINOR")],
    "todo_accumulation": [(5, "MINOR")],
}
SKILL_GRID = {
    "cyclomatic_complexity": [(15, "MAJEUR"), (10, "MINEUR")],
    "long_function": [(100, "MAJEUR"), (50, "MINEUR")],
    "duplication": [(80, "MAJEUR")],
    "low_documentation": [(30, "MINEUR")],
    "todo_accumulation": [(5, "MINEUR")],
    "no_tests": "CRITIQUE",
}
GRIDS = {"readme": README_GRID, "skill": SKILL_GRID}


def _graded(grid, smell_type: str, value: Column) -> Column:
    below = smell_type == "low_documentation"
    severity = F
    for bound, name in grid[smell_type]:
        severity = severity.when(value < bound if below else value > bound, name)
    return severity


def quality_findings(
    parsed: DataFrame, duplicates: DataFrame, tests: DataFrame | None = None,
    ruleset: str = "readme", each: bool = False,
) -> DataFrame:
    """Repo, file, smell_type, severity, line, measured_value, n_occurrences.

    ``duplicates(repo, file, similarity_percent, n_pairs)`` count duplicated pairs of
    files; there is one finding per file and severity, with the highest similarity as
    measured value and the number of pairs as occurrences, or with ``each`` one finding
    per row, with its own similarity.
    ``tests(repo, has_tests_folder)`` feeds the grid that asks for tests.
    """
    grid = GRIDS[ruleset]
    entry = lambda smell_type, line, value: F.struct(
        F.lit(smell_type).alias("smell_type"),
        _graded(grid, smell_type, value).alias("severity"),
        line.cast("bigint").alias("line"),
        value.cast("double").alias("measured_value"),
        F.lit(1).cast("bigint").alias("n_occurrences"),
    )
    none = F.lit(None).cast("bigint")
    marker_total = sum((F.col(m.lower()) for m in R.TODO_MARKERS), F.lit(0).cast("bigint"))
    per_file = F.filter(
        F.concat(
            F.transform(
                _blocks_of(),
                lambda b: entry("cyclomatic_complexity", b["lineno"], b["complexity"]),
            ),
            F.transform(
                _functions_of(), lambda b: entry("long_function", b["lineno"], b["length"])
            ),
            F.array(
                entry(
                    "low_documentation", none, documentation_columns()["documentation_ratio"]
                ),
                entry("todo_accumulation", none, marker_total),
            ),
        ),
        lambda f: f["severity"].isNotNull(),
    )
    findings = parsed.select("repo", F.col("path").alias("file"), F.inline(per_file))
    graded = duplicates.withColumn("severity", _graded(grid, "duplication", F.col("similarity_percent")))
    pairs = graded.where(F.col("severity").isNotNull()).withColumns(
        {"measured_value": F.col("similarity_percent"), "n_occurrences": F.col("n_pairs")}
    )
    if not each:
        pairs = pairs.groupBy("repo", "file", "severity").agg(
            F.max("measured_value").alias("measured_value"), F.sum("n_occurrences").alias("n_occurrences")
        )
    pairs = pairs.select(
        "repo", "file", F.lit("duplication").alias("smell_type"), "severity", none.alias("line"),
        "measured_value", "n_occurrences",
    )
    findings = findings.unionByName(pairs)
    if tests is not None and "no_tests" in grid:
        findings = findings.unionByName(
            tests.where(~F.col("has_tests_folder")).select(
                "repo",
                F.lit(None).cast("string").alias("file"),
                F.lit("no_tests").alias("smell_type"),
                F.lit(grid["no_tests"]).alias("severity"),
                none.alias("line"),
                F.lit(0.0).alias("measured_value"),
                F.lit(1).cast("bigint").alias("n_occurrences"),
            )
        )
    return findings


def debt_score(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """100 less 15, 8 and 3 points per critical, major and minor finding."""
    classes = {
        "n_critical": ["CRITICAL", "CRITIQUE"],
        "n_major": ["MAJOR", "MAJEUR"],
        "n_minor": ["MINOR", "MINEUR"],
    }
    counts = findings.groupBy("repo").agg(
        *[
            F.sum(F.when(F.col("severity").isin(names), F.col("n_occurrences"))).alias(c)
            for c, names in classes.items()
        ]
    )
    filled = repos.select("repo").join(counts, "repo", "left").select(
        "repo", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in classes]
    )
    points = 15 * F.col("n_critical") + 8 * F.col("n_major") + 3 * F.col("n_minor")
    return filled.withColumn(
        "score", F.greatest(F.lit(0), 100 - points).cast("bigint")
    )
