"""The security audit of all repositories as one lazy DataFrame graph."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registries as R
from ..operators import dependencies as D
from ..operators import owasp, scans, score, selection, tallies
from ..sources.materialize import materialize


@dataclass(frozen=True)
class AuditOptions:
    """Limits are off by default; set them to cover only the first files or packages."""

    max_secret_files: int | None = None
    max_deep_files: int | None = None
    max_deps: int | None = None
    critical_label: str = "Critical"
    strict_mask: bool = False
    dependency_lines: bool = False  # read every dependency file line by line


class SecurityAudit:
    """C3 and C4 over ``repos``, ``files`` and ``advisories``.

    The content of every selected file is read once for all scans and for dependency
    lists (:attr:`scanned`), and :attr:`counts` brings everything down to one row per
    repository.  All members are lazy DataFrames; :meth:`with_hits_written` keeps what
    was read for all of them.

    ``paths(repo, path, pos)`` names the files to analyse for some
    repositories; the others keep the automatic selection.
    """

    def __init__(
        self,
        repos: DataFrame,
        files: DataFrame,
        advisories: DataFrame,
        options: AuditOptions = AuditOptions(),
        active_maintenance: Column | None = None,
        paths: DataFrame | None = None,
    ):
        self.repos, self.files, self.options, self.paths = repos, files, options, paths
        self.active_maintenance = (
            F.lit(True) if active_maintenance is None else active_maintenance
        )
        self.advisories, self.rated_advisories = advisories, D.rated_advisories(advisories)
        self._use(self._scan(self._selected()))

    def _scan(self, selected: DataFrame) -> DataFrame:
        """Hits of all kinds and the lines of dependency files, from one pass over content."""
        kinds = (*scans.ALL_KINDS, scans.DEPENDENCY)
        specs = D.dependency_specs(F.col("path"), F.col("content"), self.options.dependency_lines)
        applies = scans.applies_by_flag() | {scans.DEPENDENCY: F.col("for_dependencies")}
        return scans.scan_files(selected, kinds, applies, self.options.strict_mask, specs)

    def _use(self, scanned: DataFrame, tallied: DataFrame | None = None) -> None:
        self.scanned, self.hits = scanned, scanned.where(F.col("kind") != scans.DEPENDENCY)
        self.dependencies = self._dependencies(scanned)
        self.tallied = tallies.tally_hits(self.hits) if tallied is None else tallied
        self.__dict__.pop("counts", None)

    @cached_property
    def counts(self) -> DataFrame:
        """One row per repository; making it already looks at the advisories."""
        return self._counts(self.tallied)

    # -- inputs -----------------------------------------------------------

    def _dependencies(self, scanned: DataFrame) -> DataFrame:
        listed = scanned.where(F.col("kind") == scans.DEPENDENCY)
        return D.scanned_dependencies(listed, self.files, self.options.max_deps)

    def _selected(self) -> DataFrame:
        """Files of either selection with a flag for each."""
        path, options = F.col("path"), self.options
        blobs = selection.blobs(self.files)
        secret, deep = selection.secret_candidate(path), selection.deep_candidate(path)
        lists = {"for_dependencies": path.isin(R.PARSED_DEPENDENCY_FILES)}
        if self.paths is None and options.max_secret_files is options.max_deep_files is None:
            flags = {"for_secrets": secret, "for_deep": deep} | lists
            return blobs.withColumns(flags).where("for_secrets OR for_deep OR for_dependencies")
        flags = ["for_secrets", "for_deep"]
        listed = selection.blobs(self.files.select("repo", "path", "kind")).where(lists["for_dependencies"])
        chosen = self._chosen_paths(secret, deep).join(listed.drop("kind"), ["repo", "path"], "full")
        return blobs.join(chosen.na.fill(False, flags), ["repo", "path"]).withColumns(lists)

    def _chosen_paths(self, secret: Column, deep: Column) -> DataFrame:
        """repo, path, for_secrets, for_deep; only path columns are read for it."""
        files, options = self.files.select("repo", "path", "kind"), self.options
        if self.paths is not None:
            files = files.join(self.paths.select("repo").distinct(), "repo", "left_anti")

        def automatic(condition, limit, flag):
            if limit is None:
                rows = selection.blobs(files).where(condition).select("repo", "path")
            else:
                rows = selection.first_files(files, condition, limit).drop("rn")
            return rows.withColumn(flag, F.lit(True))

        chosen = (
            automatic(secret, options.max_secret_files, "for_secrets")
            .join(automatic(deep, options.max_deep_files, "for_deep"), ["repo", "path"], "full")
            .na.fill(False, ["for_secrets", "for_deep"])
        )
        if self.paths is None:
            return chosen
        order = Window.partitionBy("repo").orderBy("pos")
        limits = {"for_secrets": options.max_secret_files, "for_deep": options.max_deep_files}
        listed = self.paths.select("repo", "path", F.row_number().over(order).alias("_n"))
        listed = listed.withColumns(
            {
                flag: F.lit(True) if limit is None else F.col("_n") <= limit
                for flag, limit in limits.items()
            }
        )
        return chosen.unionByName(listed.drop("_n").where("for_secrets OR for_deep"))

    def _file_facts(self) -> DataFrame:
        """Per repository what the paths alone tell, in one narrow pass."""
        path, options = F.col("path"), self.options
        blob = F.col("kind") == "blob"
        names = F.array(*[F.lit(n) for n in R.DEPENDENCY_FILES_SECURITY])
        rank = F.array_position(names, path)

        def selected(condition, limit):
            n = F.count_if(blob & condition)
            return n if limit is None else F.least(n, F.lit(limit).cast("bigint"))

        facts = self.files.groupBy("repo").agg(
            F.bool_or(F.lower(path).contains("test")).alias("has_tests"),
            F.min(F.when(blob & (rank > 0), rank)).alias("_rank"),
            selected(selection.secret_candidate(path), options.max_secret_files).alias(
                "files_scanned"
            ),
            selected(selection.deep_candidate(path), options.max_deep_files).alias(
                "files_analyzed"
            ),
        )
        facts = facts.withColumn(
            "dependency_file_scanned",
            # Spark takes element_at on a constant array for non-null whatever the index
            F.when(F.col("_rank").isNotNull(), F.element_at(names, F.col("_rank").cast("int"))),
        ).drop("_rank")
        if self.paths is None:
            return facts
        listed = self.paths.groupBy("repo").agg(F.count("*").alias("_listed"))
        capped = lambda limit: (
            F.col("_listed") if limit is None else F.least("_listed", F.lit(limit).cast("bigint"))
        )
        return facts.join(listed, "repo", "left").withColumns(
            {
                "files_scanned": F.coalesce(capped(options.max_secret_files), "files_scanned"),
                "files_analyzed": F.coalesce(capped(options.max_deep_files), "files_analyzed"),
            }
        ).drop("_listed")

    def cves(self) -> DataFrame:
        """Dependency totals per repository that lists any."""
        return D.listed_totals(
            self.dependencies, self.rated_advisories, self.options.critical_label
        )

    def _counts(self, tallied: DataFrame) -> DataFrame:
        zeros = [
            "packages_checked", "n_cves", "n_critical_cves", "n_vulnerable_packages",
            "files_scanned", "files_analyzed",
        ]
        zero = F.lit(0).cast("bigint")
        return (
            tallies.complete(self.repos, tallied)
            .join(self.cves(), "repo", "left")
            .join(self._file_facts(), "repo", "left")
            .withColumns(
                {
                    **{name: F.coalesce(name, zero) for name in zeros},
                    "has_tests": F.coalesce("has_tests", F.lit(False)),
                    "dependency_file_scanned": F.coalesce(
                        "dependency_file_scanned", F.lit("none")
                    ),
                    "active_maintenance": self.active_maintenance,
                }
            )
        )

    def with_hits_written(self) -> "SecurityAudit":
        """The same audit with its hits and dependency lines written once.

        Content is read by that write alone, whatever results are asked for.  Of the
        advisories only those of listed packages are then rated, which is slow and would
        be done again for every result.
        """
        scanned = materialize(self.scanned, "audit-hits")
        listed = D.listed_advisories(self.advisories, self._dependencies(scanned))
        self.rated_advisories = D.rated_advisories(listed)
        self._use(scanned)
        return self

    def with_counts_written(self) -> "SecurityAudit":
        """The same audit with its one row per repository written once.

        For queries that use the counts in more than one branch.
        """
        self.counts = materialize(self.counts, "audit-counts")
        return self

    # -- results ----------------------------------------------------------

    def owasp_coverage(self) -> DataFrame:
        return owasp.owasp_coverage(self.counts)

    def owasp_findings(self) -> DataFrame:
        return owasp.owasp_findings(self.hits, self.repos, self.cves())

    def security_score(self) -> DataFrame:
        return score.security_score(self.counts)

    def smells(self) -> DataFrame:
        return tallies.smells(self.hits)

    def findings_by_severity(self) -> DataFrame:
        """Dangerous findings and smells per severity, worst first by ``rank``."""
        sums = [
            ("Critical", "dangerous_critical"),
            ("High", "dangerous_high + smells_high"),
            ("Medium", "dangerous_medium + smells_medium"),
            ("Low", "dangerous_low"),
        ]
        rows = ", ".join(
            f"named_struct('severity', '{name}', 'n', {n}, 'rank', {rank})"
            for rank, (name, n) in enumerate(sums, start=1)
        )
        return self.counts.select("repo", F.expr(f"inline(array({rows}))")).where("n > 0")

    def totals(self) -> DataFrame:
        """Q7: vulnerabilities, secrets and vulnerable packages per repository."""
        return self.counts.select(
            "repo",
            F.col("n_cves").alias("total_vulnerabilities"),
            F.col("n_secrets").alias("total_secrets"),
            "n_vulnerable_packages",
        )

    def basic_report(self) -> DataFrame:
        """Dependency and secret totals with a summary sentence."""
        return self.counts.select(
            "repo",
            "dependency_file_scanned",
            "packages_checked",
            "files_scanned",
            F.col("n_cves").alias("total_vulnerabilities"),
            F.col("n_secrets").alias("total_secret_findings"),
            "n_vulnerable_packages",
            F.format_string(
                "Security analysis for %s: %d OSV vulnerability(ies) found in "
                "%d package(s), %d potential secret(s) detected in %d file(s).",
                F.col("repo"), F.col("n_cves"), F.col("n_vulnerable_packages"),
                F.col("n_secrets"), F.col("files_scanned"),
            ).alias("summary"),
        )

    def report(self) -> DataFrame:
        """C4: one wide row per repository; lists stay in their own tables."""
        n_smells = F.col("smells_high") + F.col("smells_medium")
        return score.scored(self.counts).select(
            "repo",
            "dependency_file_scanned",
            "packages_checked",
            F.col("n_cves").alias("total_vulnerabilities"),
            F.col("n_critical_cves").alias("critical_vulnerabilities"),
            F.col("n_secrets").alias("total_secret_findings"),
            "n_vulnerable_packages",
            "files_analyzed",
            "n_dangerous",
            "dangerous_critical",
            tallies.surface_total().alias("surface_total"),
            "surface_rating",
            n_smells.alias("n_smells"),
            "has_tests",
            "score",
            "risk",
            "explanation",
            F.format_string(
                "Deep security analysis of %s: %d CVE(s), %d secret(s), "
                "%d dangerous API(s), %d security smell(s). "
                "Security score: %d/30 — Risk level: %s.",
                F.col("repo"), F.col("n_cves"), F.col("n_secrets"), F.col("n_dangerous"),
                n_smells, F.col("score"), F.col("risk"),
            ).alias("summary"),
        )
