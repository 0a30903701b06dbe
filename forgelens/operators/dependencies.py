"""Dependency lists, advisories, and the join between them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registries as R
from ..functions import severity as S
from ..functions import text as T
from ..functions import versions as V
from ..sources.materialize import materialize
from .listing import dependency_file

# name, then operator and version where both follow
REQUIREMENT = r"^([a-zA-Z0-9_\-\.]+)(?:\s*([><=!~^]{1,2})\s*([\d\.\*]+))?.*$"
# the same with the whole version: pre-releases, epochs, local labels
FULL_REQUIREMENT = r"^([a-zA-Z0-9_\-\.]+)(?:\s*([><=!~^]{1,2})\s*([\w.*+!\-]+))?.*$"
SEPARATOR = "\n"  # cannot occur inside a line
PINNING_OPERATORS = ["==", "~="]
NO_SUMMARY = "No summary available"
NO_DATE = "?"
# Ecosystem whose package names are compared in one spelling, and its rule.
SPELLING_ECOSYSTEM, SPELLING_RUNS = "PyPI", "[-_.]+"
PYPROJECT = "pyproject.toml"
#: A package with more advisories than this has its versions sorted between their bounds first.
MANY = 64
#: Dependencies that make more rows with their advisories are dealt out, a part for so many.
DEAL = 4_000_000
#: So many advisories of a cell, about, meet a dependency as one row, and become rows there.
TOGETHER = 512


def requirement(line: Column, full_versions: bool = False) -> Column:
    """array with the struct(package, version) of a requirement line, or empty.

    By default a version ends before the first character that is no digit, dot or star,
    so that 1.0rc1 reads as 1.0; with ``full_versions`` it is kept whole.
    The line is matched once; the array functions only name intermediate values.
    """
    stripped = T.strip(line)
    spec = F.when(
        stripped.contains("["), F.regexp_replace(stripped, r"\[.*?\]", "")
    ).otherwise(stripped)
    groups = SEPARATOR.join(["$1", "$2", "$3"])
    pattern = FULL_REQUIREMENT if full_versions else REQUIREMENT
    fields = F.split(F.regexp_replace(spec, T.regex(pattern), groups), SEPARATOR)
    relevant = ~stripped.startswith("#") & ~stripped.startswith("-")
    return F.transform(
        # a line that does not match is not split
        F.filter(F.when(relevant, F.array(fields)), lambda f: F.size(f) == 3),
        lambda f: F.struct(
            f[0].alias("package"),
            F.when(f[1].isin(PINNING_OPERATORS), f[2]).alias("version"),
        ),
    )


def package_key(ecosystem: Column, package: Column) -> Column:
    """The name by which a package is found, whatever its spelling (PEP 503 for PyPI)."""
    plain = F.lower(F.regexp_replace(package, SPELLING_RUNS, "-"))
    return F.when(ecosystem == SPELLING_ECOSYSTEM, plain).otherwise(package)


def pyproject_specs(content: Column) -> Column:
    """D3: the quoted requirement strings inside the dependency arrays of a pyproject.toml.

    Arrays are those of ``dependencies`` (in any table), ``requires`` and, under an
    optional-dependencies or dependency-groups table, of every name.  Comments are left
    out, and brackets inside quotes do not end an array.
    """
    bare = F.regexp_replace(content, r"(?m)^((?:[^\"'#\n]|\"[^\"\n]*\"|'[^'\n]*')*)#[^\n]*$", "$1")
    tables = F.split(F.concat(F.lit("\n"), bare), r"\n\s*(?=\[[^\n]*\]\s*(?:\n|$))")
    quoted = r"(?:[^\]\"']|\"[^\"\n]*\"|'[^'\n]*')*"
    named = rf"(?m)^\s*(?:dependencies|requires)\s*=\s*\[({quoted})\]"
    every = rf"(?m)^\s*[\w\-.\"']+\s*=\s*\[({quoted})\]"
    optional = lambda t: t.rlike(r"^\s*\[(?:project\.optional-dependencies|dependency-groups)\]")
    arrays = F.flatten(
        F.transform(
            tables,
            lambda t: F.when(optional(t), F.regexp_extract_all(t, F.lit(every), F.lit(1))).otherwise(
                F.regexp_extract_all(t, F.lit(named), F.lit(1))
            ),
        )
    )
    strings = F.flatten(
        F.transform(arrays, lambda a: F.regexp_extract_all(a, F.lit(r"\"[^\"\n]*\"|'[^'\n]*'"), F.lit(0)))
    )
    return F.transform(strings, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))


def dependency_specs(filename: Column, content: Column, compat: bool = False) -> Column:
    """The requirement lines of a dependency file; ``compat`` reads every format by line."""
    lines = T.raw_lines(content)
    if compat:
        return lines
    return F.when(filename == PYPROJECT, pyproject_specs(content)).otherwise(lines)


def parse_dependency_lines(
    dep_lines: DataFrame, ecosystem: str = "PyPI", full_versions: bool = False
) -> DataFrame:
    """``dep_lines(repo, dep_file, pos, line)`` to the dependencies table."""
    return dep_lines.select(
        "repo", "dep_file", "pos", F.inline(requirement(F.col("line"), full_versions))
    ).withColumn("ecosystem", F.lit(ecosystem))


def first_dependencies(dependencies: DataFrame, max_deps: int) -> DataFrame:
    """The first ``max_deps`` dependencies of a repository in file order."""
    order = Window.partitionBy("repo").orderBy("pos")
    return (
        dependencies.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= max_deps)
        .drop("_n")
    )


def repo_dependencies(
    files: DataFrame, max_deps: int | None = None, compat: bool = False, full_versions: bool = False
) -> DataFrame:
    """S4b + F5: dependencies of the dependency file the security analysis picks.

    A picked file of a format that is not parsed yields no dependency.
    """
    picked = dependency_file(files, R.DEPENDENCY_FILES_SECURITY, with_content=True)
    dep_lines = picked.where(F.col("filename").isin(R.PARSED_DEPENDENCY_FILES)).select(
        "repo",
        F.col("filename").alias("dep_file"),
        F.posexplode(dependency_specs(F.col("filename"), F.col("content"), compat)).alias(
            "pos", "line"
        ),
    )
    parsed = parse_dependency_lines(dep_lines, full_versions=full_versions)
    return parsed if max_deps is None else first_dependencies(parsed, max_deps)


def scanned_dependencies(
    hits: DataFrame, files: DataFrame, max_deps: int | None = None
) -> DataFrame:
    """S4b + F5 from the lines that a content scan has brought along.

    Of the dependency files of a repository that ``files`` lists, the first in the order
    of the security analysis counts; only paths are read for that.
    """
    picked = dependency_file(files, R.DEPENDENCY_FILES_SECURITY)
    lines = hits.select(
        "repo", F.col("key").alias("dep_file"), F.col("lineno").cast("int").alias("pos"), F.col("text").alias("line")
    )
    chosen = lines.join(picked.withColumnRenamed("filename", "dep_file"), ["repo", "dep_file"], "left_semi")
    parsed = parse_dependency_lines(chosen)
    return parsed if max_deps is None else first_dependencies(parsed, max_deps)


def rated_advisories(advisories: DataFrame) -> DataFrame:
    """every advisory once with its severity, before it meets any dependency."""
    found = S.advisory_json_severity(F.col("raw_json"))
    return (
        advisories.withColumn("_json", found)
        .withColumn(
            "severity",
            S.severity(
                F.col("_json.score"),
                F.col("_json.label"),
                F.col("summary"),
                F.col("details"),
                F.get_json_object("raw_json", "$.description"),
            ),
        )
        .drop("_json")
    )


def listed_advisories(advisories: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The advisories of packages that some repository lists, to be rated before they meet the lists.

    The names of the packages are written, so that Spark knows how few they are.
    """
    key = package_key(F.col("ecosystem"), F.col("package")).alias("_key")
    names = materialize(dependencies.select("ecosystem", key).distinct(), "listed-packages")
    return advisories.withColumn("_key", key).join(names, ["ecosystem", "_key"], "left_semi").select(advisories.columns)


def advisory_severity(advisories: DataFrame) -> DataFrame:
    return rated_advisories(advisories).select("id", "severity")


def dependency_vulnerabilities(
    dependencies: DataFrame, rated: DataFrame, how: str = "left", extra=()
) -> DataFrame:
    """A row per dependency and advisory; a clean dependency keeps one row.

    An equi-join on ecosystem and :func:`package_key` with the version test as the
    rest of the condition; the package keeps the spelling of the list.  Spark
    broadcasts the advisories where they are small and splits the dependencies of a
    hot package where they are not.

    Packages with more than ``MANY`` advisories are looked for when this is called: there
    versions are not tested one by one, see :func:`_by_cell`.
    """
    key = package_key(F.col("ecosystem"), F.col("package"))
    deps, adv = dependencies.withColumn("_key", key), rated.withColumn("_key", key)
    shown = list(dict.fromkeys(["id", "summary", "severity", "published", "aliases", *extra]))
    many = adv.groupBy("ecosystem", "_key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).drop("n")
    if many.isEmpty():
        met = _one_by_one(deps, adv, how)
    else:
        many = materialize(many, "much-advised")
        few = [frame.join(many, ["ecosystem", "_key"], "left_anti") for frame in (deps, adv)]
        much = [frame.join(many, ["ecosystem", "_key"], "left_semi") for frame in (deps, adv)]
        met = _both(_one_by_one(*few, how), deps.columns, shown).unionByName(_by_cell(*much, how, shown))
    matched = F.col("a.id").isNotNull()
    return met.select(
        *[f"d.{name}" for name in dependencies.columns],
        "a.id",
        F.when(matched, F.coalesce("a.summary", F.lit(NO_SUMMARY))).alias("summary"),
        "a.severity",
        F.when(matched, F.coalesce("a.published", F.lit(NO_DATE))).alias("published"),
        F.when(
            matched, F.coalesce("a.aliases", F.array().cast("array<string>"))
        ).alias("aliases"),
        *[f"a.{name}" for name in extra],
    )


def _both(joined: DataFrame, deps: list[str], adv: list[str]) -> DataFrame:
    """Struct ``d`` with columns of a dependency, struct ``a`` with those of an advisory."""
    return joined.select(
        F.struct(*[f"d.{name}" for name in deps]).alias("d"), F.struct(*[f"a.{name}" for name in adv]).alias("a")
    )


def _one_by_one(deps: DataFrame, adv: DataFrame, how: str) -> DataFrame:
    """Every dependency against every advisory of its package."""
    deps = deps.withColumn("_version", V.version_key(F.col("version")))
    adv = adv.withColumn("_spans", V.span_keys(F.col("affected")))
    condition = (
        (F.col("d.ecosystem") == F.col("a.ecosystem"))
        & (F.col("d._key") == F.col("a._key"))
        & V.affects(F.col("a._spans"), F.col("a.versions"), F.col("d.version"), F.col("d._version"))
    )
    return deps.alias("d").join(adv.alias("a"), condition, how)


def _by_cell(deps: DataFrame, adv: DataFrame, how: str, shown: list[str]) -> DataFrame:
    """The same rows, where the versions are tested once per cell.

    The bounds of a package's ranges cut its versions into cells; versions between the same
    two bounds lie in the same ranges.  A version that an advisory lists is a cell of its own,
    and so are all that are not pinned.  A cell stands for its versions by the bound below
    it, which is in the same ranges.  What is left are equal keys, so that time goes with
    the rows that come out; the dependencies of a cell with very many are dealt out, and its
    advisories meet them as arrays of about ``TOGETHER``, one array for each shown column.
    """
    package = ["ecosystem", "_key"]
    parts = int(deps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deps = materialize(deps, "much-advised-lists")
    # dealt out, so that not one task goes through the ranges
    spans = {"_spans": V.span_keys(F.col("affected")), "_number": F.monotonically_increasing_id()}
    adv = materialize(adv.repartition(parts, "ecosystem", "_key", "id").withColumns(spans), "many-advisories")
    # the key of a version is worked out once, not once a list
    specs = deps.groupBy(*package, "version").agg(F.count("*").alias("n"))
    specs = specs.withColumn("_version", V.version_key(F.col("version")))
    ends = F.flatten(F.transform("_spans", lambda span: F.array(span["low"], span["high"])))
    bounds = adv.select(*package, F.explode(ends).alias("_version")).where("_version is not null").distinct()
    listed = adv.select(*package, F.explode("versions").alias("version")).distinct().withColumn("listed", F.col("version"))
    below = Window.partitionBy(*package).orderBy("_version").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        specs.unionByName(bounds.withColumn("floor", F.col("_version")), allowMissingColumns=True)
        .withColumn("floor", F.last("floor", ignorenulls=True).over(below))
        .where("n is not null")
        .join(listed, [*package, "version"], "left")
    )
    text = lambda value, mark: F.coalesce(F.concat(F.lit(mark), value), F.lit(""))
    cell = F.when(V.is_pinned(F.col("version")), F.concat(text(F.hex("floor"), "+"), text(F.col("listed"), "="))).otherwise("*")
    placed = materialize(placed.withColumn("_cell", cell), "placed-versions")
    cells = placed.groupBy(*package, "_cell").agg(
        F.sum("n").alias("n"), F.first("floor").alias("floor"), F.max("listed").alias("listed")
    )
    covers = (F.col("c._cell") == "*") | V.covers(
        F.col("a._spans"), F.col("a.versions"), F.col("c.listed"), F.col("c.floor")
    )
    same = (F.col("c.ecosystem") == F.col("a.ecosystem")) & (F.col("c._key") == F.col("a._key"))
    met = cells.alias("c").join(adv.alias("a"), same & covers).select("c.ecosystem", "c._key", "c._cell", "c.n", "a._number")
    met = materialize(met, "advised-cells")
    # both counts fit: a cell is dealt out by the rows that it makes
    rows = met.groupBy(*package, "_cell").agg(F.count("*").alias("advisories"), F.first("n").alias("n"))
    deal = F.least(F.expr(f"advisories * n div {DEAL}"), F.col("n")).cast("int").alias("deal")
    pieces = F.expr(f"cast(advisories div {TOGETHER} as int)").alias("pieces")
    dealt = materialize(rows.select(*package, "_cell", deal, pieces), "dealt-cells")
    name = placed.join(dealt, [*package, "_cell"], "left").select(
        *package, F.col("version").alias("_spec"), "_cell", F.coalesce("deal", F.lit(0)).alias("_deals")
    )
    named = deps.alias("l").join(
        name.alias("s"),
        (F.col("l.ecosystem") == F.col("s.ecosystem")) & (F.col("l._key") == F.col("s._key"))
        & F.col("l.version").eqNullSafe(F.col("s._spec")),
    )
    whole = F.xxhash64(*[f"l.{name}" for name in deps.columns])
    left = named.select("l.*", "s._cell", F.pmod(whole, F.col("s._deals") + 1).cast("int").alias("_deal"))
    # by number, since few bytes can make many rows: by size they would be one task
    left = left.repartition(parts, *package, "_cell", "_deal")
    # an array for each column, all in one order, so that columns nobody asks for are not collected
    inside = {f"_{n}": F.transform(F.sort_array(F.collect_list(F.struct("_number", F.col(c).alias("_value")))), lambda v: v["_value"])
              for n, c in enumerate(shown)}
    piece = F.pmod(F.xxhash64("_number"), F.col("pieces") + 1).alias("_piece")
    right = met.join(dealt, [*package, "_cell"]).join(adv.select("_number", *shown), "_number")
    right = right.groupBy(*package, "_cell", "deal", piece).agg(
        F.collect_list("_number").alias("_numbers"), *[array.alias(n) for n, array in inside.items()]
    )
    right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0), "deal"))).drop("deal", "_piece")
    each = F.posexplode if how == "inner" else F.posexplode_outer
    joined = left.join(right, [*package, "_cell", "_deal"], how).select("*", each("_numbers").alias("_at", "_each"))
    return joined.select(
        F.struct(*deps.columns).alias("d"),
        F.struct(*[F.col(n)[F.col("_at")].alias(c) for n, c in zip(inside, shown)]).alias("a"),
    )


def version_order(dependencies: DataFrame) -> DataFrame:
    """package, version, place: the versions a package is listed with, in their order.

    Spellings of one version share a place; missing versions and wildcards have none.
    """
    listed = dependencies.where(V.is_pinned(F.col("version"))).select("ecosystem", "package", "version").distinct()
    place = F.dense_rank().over(Window.partitionBy("ecosystem", "package").orderBy(V.version_key(F.col("version"))))
    return listed.select("ecosystem", "package", "version", place.alias("place"))


def dependency_counts(
    dependencies: DataFrame, rated: DataFrame, critical_label: str = "Critical"
) -> DataFrame:
    """Advisories per dependency, counted per distinct (package, version) first.

    A package that every repository depends on meets its advisories once per
    version, and the dependencies themselves are never multiplied.
    """
    specs = dependencies.select("ecosystem", "package", "version").distinct()
    by_spec = (
        dependency_vulnerabilities(specs, rated, "inner")
        .groupBy("ecosystem", "package", F.coalesce("version", F.lit("")).alias("_version"))
        .agg(
            F.count("*").alias("vuln_count"),
            F.count_if(F.col("severity") == critical_label).alias("critical_count"),
        )
    )
    counted = dependencies.withColumn("_version", F.coalesce("version", F.lit(""))).join(
        by_spec, ["ecosystem", "package", "_version"], "left"
    )
    zero = F.lit(0).cast("bigint")
    return counted.drop("_version").withColumns(
        {
            "vuln_count": F.coalesce("vuln_count", zero),
            "critical_count": F.coalesce("critical_count", zero),
        }
    )


def vulnerability_totals(counts: DataFrame) -> DataFrame:
    """Q7/Q8: sums per repository; list entries count, as often as they are listed."""
    return counts.groupBy("repo").agg(
        F.count("*").alias("packages_checked"),
        F.sum("vuln_count").alias("n_cves"),
        F.sum("critical_count").alias("n_critical_cves"),
        F.count_if(F.col("vuln_count") > 0).alias("n_vulnerable_packages"),
    )


def listed_totals(
    dependencies: DataFrame, rated: DataFrame, critical_label: str = "Critical"
) -> DataFrame:
    """Q7/Q8 straight from the lists, which are read once.

    For lists as short as dependency files; :func:`dependency_counts` spares a package
    that everyone lists from meeting its advisories once per list.
    """
    per_entry = dependency_vulnerabilities(dependencies, rated).groupBy(
        "repo", "dep_file", "pos", "package", "version"
    ).agg(
        F.count("id").alias("vuln_count"),
        F.count_if(F.col("severity") == critical_label).alias("critical_count"),
    )
    return vulnerability_totals(per_entry)


def vulnerable_packages(counts: DataFrame) -> DataFrame:
    """Listed packages with an advisory, in file order by ``pos``."""
    return counts.where("vuln_count > 0").select("repo", "pos", "package", "vuln_count")


def _package_matches(dependencies: DataFrame, rated: DataFrame) -> DataFrame:
    per_package = dependencies.select("repo", "ecosystem", "package", "version").distinct()
    return dependency_vulnerabilities(per_package, rated, "inner")


def package_advisory_ids(dependencies: DataFrame, rated: DataFrame) -> DataFrame:
    """Q11: repo, package, id of every advisory a listed package has, once each."""
    return _package_matches(dependencies, rated).select("repo", "package", "id").distinct()


def package_vulnerability_rollup(dependencies: DataFrame, rated: DataFrame) -> DataFrame:
    """Q11: per package the number of advisories and the worst severity.

    One narrow row per package, whatever its number of advisories; their ids are in
    :func:`package_advisory_ids`.
    """
    rank = S.severity_rank(F.col("severity"))
    once = _package_matches(dependencies, rated).groupBy("repo", "package", "id").agg(
        F.min(rank).alias("_rank")
    )
    rolled = once.groupBy("repo", "package").agg(
        F.count("*").alias("n_cve"), F.min("_rank").alias("severity_rank")
    )
    return rolled.withColumn("max_severity", S.severity_name(F.col("severity_rank")))
