"""Mapping of findings to the OWASP Top 10."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registries as R
from ..functions.text import quoted
from . import scans
from .tallies import DENSITY, RULES, rules_of, sum_of

DETECTED, CONFIRMED = "Detected", "Confirmed"
SUSPICIOUS, MANUAL = "Suspicious", "Manual Review Recommended"


def owasp_coverage(counts: DataFrame) -> DataFrame:
    """O1: ten rows per repository with the number of findings and the status.

    Works on the per-repository counts (``n_cves`` included), so the ten
    categories are an ``inline`` of one row and no join is needed.
    """
    rows = []
    for category, label, description in R.OWASP_CATEGORIES:
        detected, confirmed, other = _counts(category)
        total = f"({detected} + {confirmed} + {other})"
        status = (
            f"CASE WHEN {total} = 0 THEN 'No evidence found.' "
            f"WHEN {confirmed} > 0 THEN format_string('%d confirmed finding(s).', {confirmed}) "
            f"WHEN {detected} > 0 THEN format_string("
            f"'%d dangerous pattern(s) detected — review recommended.', {detected}) "
            "ELSE 'Manual review recommended.' END"
        )
        rows.append(
            f"named_struct('category', {quoted(category)}, 'label', {quoted(label)}, "
            f"'description', {quoted(description)}, 'n_findings', {total}, 'status', {status})"
        )
    return counts.select("repo", F.expr(f"inline(array({', '.join(rows)}))"))


def _counts(category: str) -> tuple[str, str, str]:
    """SQL counts of detected, confirmed and other findings of a category."""
    detected = f"({sum_of(rules_of(scans.DANGEROUS, owasp=category))})"
    smells = f"({sum_of(rules_of(scans.SMELL, owasp=category))})"
    confirmed, other = "0L", smells
    if category == R.COMPONENTS_CATEGORY:
        confirmed = "CAST(n_cves > 0 AS BIGINT)"
    if category == R.CRYPTO_CATEGORY:
        other = f"({smells} + CAST(n_secrets > 0 AS BIGINT))"
    if category in (R.LOGGING_CATEGORY, R.SSRF_CATEGORY):
        other = f"({smells} + 1L)"
    return detected, confirmed, other


def owasp_findings(hits: DataFrame, repos: DataFrame, cves: DataFrame) -> DataFrame:
    """The findings behind the coverage, one row each: repo, category, type, source.

    Content is scanned once: a hit is its own finding, counts towards one of its
    repository (secrets, density of weak cryptography), or both.  ``cves`` holds
    ``n_cves`` per repository.
    """
    titles = {r.key: r for r in RULES if r.kind == scans.SMELL and r.owasp}
    kind, key = F.col("kind"), F.col("key")
    rule = F.col("_rule")
    entry = lambda category, type_, source: F.struct(
        category.alias("category"), F.lit(type_).alias("type"), source.alias("source")
    )
    crypto = rule["owasp"] == R.CRYPTO_CATEGORY
    smell_category = F.when(
        key.isin([t for t, r in titles.items() if r.owasp == R.DESIGN_CATEGORY]),
        R.DESIGN_CATEGORY,
    ).when(key.isin(list(titles)), R.MISCONFIGURATION_CATEGORY)
    smell = entry(smell_category, None, F.concat(F.lit("Security Smell: "), key)).withField(
        "type", F.when(smell_category == R.DESIGN_CATEGORY, MANUAL).otherwise(SUSPICIOUS)
    )
    # null as source: the row is worked out from the number of hits behind it
    belongs = F.array(
        F.when(
            kind == scans.DANGEROUS,
            entry(
                rule["owasp"],
                DETECTED,
                F.format_string(
                    "[%s] %s — %s:%d", key, rule["title"], F.col("path"), F.col("lineno")
                ),
            ),
        ),
        F.when((kind == scans.SMELL) & smell_category.isNotNull(), smell),
        F.when(
            (kind == scans.DANGEROUS) & crypto,
            entry(F.lit(R.DESIGN_CATEGORY), MANUAL, F.lit(None).cast("string")),
        ),
        F.when(
            kind == scans.SECRET,
            entry(F.lit(R.CRYPTO_CATEGORY), SUSPICIOUS, F.lit(None).cast("string")),
        ),
    )
    rows = (
        hits.withColumn("_rule", scans.rule_texts(key))
        .select("repo", "path", F.inline(F.filter(belongs, lambda b: b.isNotNull())))
        # the path keeps equal smells of different files apart
        .withColumn("path", F.when(F.col("source").isNotNull(), F.col("path")))
        .groupBy("repo", "category", "type", "source", "path")
        .agg(F.count("*").alias("n"))
    )
    counted, secret = F.col("source").isNull(), F.col("type") == SUSPICIOUS
    from_content = rows.where(~counted | secret | (F.col("n") >= R.WEAK_CRYPTO_LIMIT)).select(
        "repo",
        "category",
        "type",
        F.when(~counted, F.col("source"))
        .when(
            secret,
            F.format_string("%d potential secrets exposed in source files.", F.col("n")),
        )
        .otherwise(F.lit("Security Smell: " + DENSITY.title))
        .alias("source"),
    )
    confirmed = cves.where("n_cves > 0").select(
        "repo",
        F.lit(R.COMPONENTS_CATEGORY).alias("category"),
        F.lit(CONFIRMED).alias("type"),
        F.format_string(
            "%d CVE(s) detected in dependencies via OSV.dev.", F.col("n_cves")
        ).alias("source"),
    )
    notes = F.array(
        entry(F.lit(R.LOGGING_CATEGORY), MANUAL, F.lit(R.LOGGING_NOTE)),
        entry(F.lit(R.SSRF_CATEGORY), MANUAL, F.lit(R.SSRF_NOTE)),
    )
    return from_content.unionByName(confirmed).unionByName(
        repos.select("repo", F.inline(notes))
    )
