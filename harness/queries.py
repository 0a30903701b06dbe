"""Registered queries: every operator over the audit tables of ``tables``."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.operators import (
    agents,
    dependencies as deps,
    duplication,
    hotspots,
    listing,
    quality,
    reports,
    scans,
    score,
    selection,
    tallies,
)
from forgelens.operators.long_files import scan_pieces
from forgelens.plans.actions import action_plan
from forgelens.plans.audit import AuditOptions, SecurityAudit
from forgelens.plans.incremental import AuditState
from forgelens.plans.report_text import report_lines
from forgelens.sources.events import read_event_log
from forgelens.sources.long_files import read_long_files
from forgelens.sources.materialize import materialize, shared_folder
from forgelens.sources.sinks import write_reports
from forgelens.streaming.churn import churn_windows

from . import tables as T


def _audit(spark, d, options=AuditOptions()) -> SecurityAudit:
    audit = SecurityAudit(T.repos(spark, d), T.code_files(spark, d), T.advisories(spark, d), options)
    return audit.with_hits_written()


def _secret_files(spark, d) -> DataFrame:
    return selection.select_files(T.code_files(spark, d), selection.secret_candidate(F.col("path")))


def _deep_files(spark, d) -> DataFrame:
    return selection.select_files(T.code_files(spark, d), selection.deep_candidate(F.col("path")))


def _files(spark, d) -> DataFrame:
    return selection.blobs(T.code_files(spark, d))


def _parsed(spark, d) -> DataFrame:
    return quality.parse_files(T.py_files(spark, d))


def _order_deps(spark, d) -> DataFrame:
    return deps.parse_dependency_lines(T.dep_lines(spark, d))


def _rated(spark, d) -> DataFrame:
    return deps.rated_advisories(T.advisories(spark, d))


def _churn(spark, d) -> DataFrame:
    return listing.file_churn(T.commits(spark, d), T.AS_OF)


def _selected_pairs(spark, d) -> DataFrame:
    files = T.py_files(spark, d)
    return duplication.pair_matrix(files, selection.analyst_selection(files))


def _quality(spark, d, parsed=None) -> DataFrame:
    """Findings of whole repositories; duplication between all files as numbers of pairs, under no file."""
    duplicates = duplication.Duplication(T.py_files(spark, d)).by_similarity()
    none = F.lit(None).cast("string")
    return quality.quality_findings(parsed or _parsed(spark, d), duplicates.withColumn("file", none))


def quality_findings(spark, d) -> DataFrame:
    """Every finding, of duplication one for each pair of line sets."""
    pairs = duplication.similar_pairs(T.py_files(spark, d)).withColumnRenamed("file_a", "file")
    return quality.quality_findings(_parsed(spark, d), pairs, each=True)


def _actions(spark, d, audit, parsed=None) -> DataFrame:
    rollup = deps.package_vulnerability_rollup(audit.dependencies, audit.rated_advisories)
    return action_plan(audit.counts, rollup, _quality(spark, d, parsed))


def secret_scan_selected(spark, d) -> DataFrame:
    files = selection.select_files(
        T.code_files(spark, d), selection.secret_candidate(F.col("path")), max_files=10
    )
    return scans.secret_scan(files)


def dangerous_scan(spark, d) -> DataFrame:
    return scans.dangerous_scan(_deep_files(spark, d))


def security_score(spark, d) -> DataFrame:
    return _audit(spark, d).security_score().select(
        "repo",
        "score",
        "risk",
        F.size("positive_factors").alias("n_positive"),
        F.size("negative_factors").alias("n_negative"),
        "explanation",
    )


def security_score_compat(spark, d) -> DataFrame:
    """No severity carries this label, so every CVE counts as non-critical."""
    audit = _audit(spark, d, AuditOptions(critical_label="Critique"))
    return audit.security_score().select("repo", "score")


def smells(spark, d) -> DataFrame:
    kinds = [scans.DANGEROUS, scans.SURFACE, scans.SMELL]
    return tallies.smells(scans.scan_files(_deep_files(spark, d), kinds)).drop("detail")


def smell_details(spark, d) -> DataFrame:
    kinds = [scans.DANGEROUS, scans.SURFACE, scans.SMELL]
    return tallies.smells(scans.scan_files(_deep_files(spark, d), kinds))


def secret_scan_listed(spark, d) -> DataFrame:
    """Listed files, whatever their path, in place of the selection of their repositories."""
    files = selection.select_files(
        T.code_files(spark, d), selection.secret_candidate(F.col("path")), max_files=5, paths=T.listed_paths(spark, d)
    )
    return scans.secret_scan(files)


def secret_scan_long_files(spark, d) -> DataFrame:
    """Secrets of files that are read in pieces, numbered over the whole file."""
    root = f"{shared_folder(spark).rstrip('/')}/long-files-{uuid.uuid4().hex}"
    T.write_long_files(_secret_files(spark, d), root)
    found = scans.secret_findings(scan_pieces(read_long_files(spark, root, 0), [scans.SECRET]))
    return found.select(
        F.regexp_extract("repo", "^repo=([^/]*)/", 1).alias("repo"),
        F.regexp_extract("repo", "/chapter=(.*)$", 1).cast("bigint").alias("chapter"),
        "lineno",
        "pattern",
        "snippet",
    )


def quality_findings_skill(spark, d) -> DataFrame:
    """The second grid, which also asks for tests."""
    files = T.py_files(spark, d)
    least = min(bound for bound, _ in quality.GRIDS["skill"]["duplication"])  # no finding below
    duplicates = duplication.Duplication(files, least).by_file()  # all above one bound: one severity
    return quality.quality_findings(_parsed(spark, d), duplicates, listing.has_tests(files), "skill")


def event_log(spark, d) -> DataFrame:
    """Events written as JSON lines and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/event-log-{uuid.uuid4().hex}"
    T.event_lines(spark, d).write.text(path)
    events = read_event_log(spark, path)
    return events.withColumn("tools", F.array_join("tools", ","))


def report_text(spark, d) -> DataFrame:
    """Report lines, written by the sink and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    write_reports(report_lines(_audit(spark, d)), path)
    return spark.read.parquet(f"{path}/lines")


def owasp_coverage(spark, d) -> DataFrame:
    return _audit(spark, d).owasp_coverage()


def updated_report(spark, d) -> DataFrame:
    """The report after two updates: an earlier state of the files, then the files as they are."""
    folder, files = shared_folder(spark), T.code_files(spark, d)
    state = AuditState(spark)
    for version in (T.earlier_files(files), files):
        version = materialize(version, "files")
        listing = version.withColumn("content_hash", F.sha2("content", 256))
        state = state.update(listing, lambda asked, v=version: v.join(asked, ["repo", "path"], "left_semi"), folder)
    return state.audit(T.repos(spark, d), T.advisories(spark, d)).report()


def first_dependencies(spark, d) -> DataFrame:
    found = deps.repo_dependencies(T.code_files(spark, d), max_deps=20)
    return found.select("repo", "package", "version")


def dependency_vulnerabilities(spark, d) -> DataFrame:
    return deps.dependency_vulnerabilities(_order_deps(spark, d), _rated(spark, d)).select(
        "repo", "pos", "package", "version", "id", "severity", "summary", "published",
        F.array_join("aliases", ",").alias("aliases"),
    )


def dependency_vulnerabilities_spelling(spark, d) -> DataFrame:
    """Lists and advisories spell the same packages differently."""
    listed = deps.parse_dependency_lines(T.respelled_dep_lines(spark, d))
    rated = deps.rated_advisories(T.respelled_advisories(spark, d))
    return deps.dependency_vulnerabilities(listed, rated, "inner").select(
        "repo", "pos", "package", "version", "id", "severity"
    )


def _releases(spark, d) -> DataFrame:
    return deps.parse_dependency_lines(T.release_lines(spark, d), full_versions=True)


def dependency_vulnerabilities_releases(spark, d) -> DataFrame:
    """Lists and ranges with pre-, post- and development releases, epochs and local labels."""
    rated = deps.rated_advisories(T.release_advisories(spark, d))
    found = deps.dependency_vulnerabilities(_releases(spark, d), rated, "inner")
    return found.select("repo", "pos", "package", "version", "id")


def dependency_counts(spark, d) -> DataFrame:
    return deps.dependency_counts(_order_deps(spark, d), _rated(spark, d)).select(
        "repo", "pos", "package", "version", "vuln_count", "critical_count"
    )


def report_consistency(spark, d) -> DataFrame:
    audit = _audit(spark, d).with_counts_written()
    parsed = materialize(_parsed(spark, d), "parsed")  # sources are parsed once
    spots = hotspots.hotspots(parsed, _churn(spark, d))
    order = reports.plan_order(_actions(spark, d, audit, parsed))
    return reports.report_consistency(score.scored(audit.counts), order, spots)


def action_plan_of(spark, d) -> DataFrame:
    return _actions(spark, d, _audit(spark, d))


QUERIES = {
    # sources and listing
    "repo_structure": lambda s, d: listing.repo_structure(T.repos(s, d), T.code_files(s, d)),
    "repo_scan": lambda s, d: listing.repo_scan(
        T.repos(s, d), T.code_files(s, d), T.commits(s, d)
    ),
    "file_sizes": lambda s, d: listing.file_sizes(T.code_files(s, d)),
    "file_extensions": lambda s, d: listing.file_extensions(T.code_files(s, d)),
    "file_language": lambda s, d: listing.file_language(T.code_files(s, d)),
    "has_tests": lambda s, d: listing.has_tests(T.code_files(s, d)),
    "dependency_file": lambda s, d: listing.dependency_file(T.code_files(s, d)),
    "dependency_file_security": lambda s, d: listing.dependency_file(
        T.code_files(s, d), ["requirements.txt", "pyproject.toml", "package.json"]
    ),
    "commit_activity": lambda s, d: listing.commit_activity(T.commits(s, d)),
    "file_churn": _churn,
    "file_churn_week": lambda s, d: listing.file_churn(
        T.commits(s, d), T.AS_OF, days=7, commit_cap=10
    ),
    "churn_history": lambda s, d: listing.churn_history(
        T.commits(s, d), "2024-01-01 00:00:00", n_dates=35, days=7, commit_cap=10
    ),
    "churn_windows": lambda s, d: churn_windows(T.commits(s, d), days=7),
    # selection
    "secret_candidates": lambda s, d: selection.secret_candidates(T.code_files(s, d)),
    "deep_candidates": lambda s, d: selection.deep_candidates(T.code_files(s, d)),
    "first_secret_candidates": lambda s, d: selection.secret_candidates(T.code_files(s, d), 10),
    "first_deep_candidates": lambda s, d: selection.deep_candidates(T.code_files(s, d), 20),
    "analyst_selection": lambda s, d: selection.analyst_selection(T.py_files(s, d)),
    # content scans
    "secret_scan": lambda s, d: scans.secret_scan(_secret_files(s, d)),
    "secret_counts": lambda s, d: scans.secret_counts(_secret_files(s, d)),
    "secret_scan_selected": secret_scan_selected,
    "dangerous_scan": dangerous_scan,
    "attack_surface_hits": lambda s, d: scans.attack_surface_hits(_files(s, d)),
    "attack_surface": lambda s, d: tallies.attack_surface(T.repos(s, d), _files(s, d)),
    "attack_surface_rating": lambda s, d: tallies.attack_surface_rating(
        T.repos(s, d), _files(s, d)
    ),
    "secret_scan_listed": secret_scan_listed,
    "secret_scan_long_files": secret_scan_long_files,
    "smells": smells,
    "smell_details": smell_details,
    # audit
    "owasp_coverage": owasp_coverage,
    "owasp_findings": lambda s, d: _audit(s, d).owasp_findings(),
    "security_score": security_score,
    "security_score_compat": security_score_compat,
    "top_negative_factors": lambda s, d: score.top_negative_factors(_audit(s, d).security_score()),
    "findings_by_severity": lambda s, d: _audit(s, d).findings_by_severity(),
    "security_totals": lambda s, d: _audit(s, d).totals(),
    "repo_security_basic": lambda s, d: _audit(s, d).basic_report(),
    "updated_report": updated_report,
    "repo_security_report": lambda s, d: _audit(s, d).report(),
    # dependencies
    "dependencies": lambda s, d: _order_deps(s, d).select("repo", "pos", "package", "version"),
    "first_dependencies": first_dependencies,
    "advisory_severity": lambda s, d: deps.advisory_severity(T.advisories(s, d)),
    "dependency_vulnerabilities": dependency_vulnerabilities,
    "dependency_vulnerabilities_spelling": dependency_vulnerabilities_spelling,
    "dependency_vulnerabilities_releases": dependency_vulnerabilities_releases,
    "version_order": lambda s, d: deps.version_order(_releases(s, d)).drop("ecosystem"),
    "dependency_counts": dependency_counts,
    "vulnerable_packages": lambda s, d: deps.vulnerable_packages(dependency_counts(s, d)),
    "package_advisory_ids": lambda s, d: deps.package_advisory_ids(
        _order_deps(s, d), _rated(s, d)
    ),
    "package_vulnerability_rollup": lambda s, d: deps.package_vulnerability_rollup(
        _order_deps(s, d), _rated(s, d)
    ),
    # code quality
    "todo_counts": lambda s, d: quality.todo_counts(T.py_files(s, d)),
    "functions": lambda s, d: quality.functions(_parsed(s, d)),
    "long_functions": lambda s, d: quality.long_functions(_parsed(s, d)),
    "complex_functions": lambda s, d: quality.complex_functions(_parsed(s, d)),
    "documentation_ratio": lambda s, d: quality.documentation_ratio(_parsed(s, d)),
    "max_complexity": lambda s, d: quality.max_complexity(_parsed(s, d)),
    "hotspots": lambda s, d: hotspots.hotspots(_parsed(s, d), _churn(s, d)),
    "file_hotspot_analysis": lambda s, d: hotspots.file_hotspot_analysis(
        _parsed(s, d), _churn(s, d)
    ),
    "file_quality": lambda s, d: quality.file_quality(_parsed(s, d)),
    "quality_findings": quality_findings,
    "quality_findings_skill": quality_findings_skill,
    "debt_score": lambda s, d: quality.debt_score(T.repos(s, d), _quality(s, d)),
    "duplication_pairs": lambda s, d: duplication.similar_pairs(T.text_files(s, d)),
    "duplication_classes": lambda s, d: duplication.Duplication(T.text_files(s, d)).classes(),
    "duplication_class_members": lambda s, d: duplication.Duplication(T.text_files(s, d)).members(),
    "duplication_members": lambda s, d: duplication.set_members(T.text_files(s, d)),
    "selected_duplication": _selected_pairs,
    # reports and agents
    "action_plan": action_plan_of,
    "report_metrics": lambda s, d: reports.report_metrics(T.reports(s, d)),
    "report_sections": lambda s, d: reports.report_sections(T.reports(s, d)),
    "report_tabs": lambda s, d: reports.report_tabs(T.reports(s, d)),
    "report_consistency": report_consistency,
    "report_text": report_text,
    "event_log": event_log,
    "agent_timeline": lambda s, d: agents.agent_timeline(T.agent_events(s, d)),
    "agent_tools": lambda s, d: agents.agent_tools(T.tool_events(s, d)),
    "session_transcript": lambda s, d: agents.session_transcript(T.agent_events(s, d)),
}
