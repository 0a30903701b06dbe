"""Per-repository counts over the content hits, and what follows from them.

One ``groupBy("repo")`` counts the hits of every single rule, with map-side
partial aggregation: a task sends one row per repository whatever the number of
hits.  Everything per repository (surface rating, OWASP coverage, score, action
plan) is a projection of that row, so content is read once for all of them.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registries as R
from ..functions.text import quoted
from . import scans

SURFACES = list(R.ATTACK_SURFACE_PATTERNS)
SEVERITIES = ["Critical", "High", "Medium", "Low"]


@dataclass(frozen=True)
class Rule:
    """A countable rule: the column of its count and how its hits look."""

    column: str
    kind: str
    key: str
    severity: str | None = None
    title: str | None = None
    owasp: str | None = None


def _smell_owasp(title: str) -> str | None:
    lowered = title.lower()
    if any(part in lowered for part in ("disable", "csrf", "bypass")):
        return R.MISCONFIGURATION_CATEGORY
    return R.DESIGN_CATEGORY if "God" in title or "density" in lowered else None


def _smell_rule(column: str, severity: str, title: str) -> Rule:
    return Rule(column, scans.SMELL, title, severity, title, _smell_owasp(title))


RULES = [
    *[
        Rule(f"secret_{i}", scans.SECRET, name, title=name)
        for i, (name, _) in enumerate(R.SECRET_PATTERNS, start=1)
    ],
    *[
        Rule(rule[0].replace("-", "_"), scans.DANGEROUS, rule[0], rule[3], rule[4], rule[7])
        for rule in R.DANGEROUS_PATTERNS
    ],
    *[Rule(category, scans.SURFACE, category) for category in SURFACES],
    _smell_rule("smell_god", "Medium", scans.GOD_OBJECT),
    *[
        _smell_rule(f"smell_legacy_{i}", "Medium", scans.LEGACY_ENGINE + name)
        for i, (_, name) in enumerate(R.LEGACY_ENGINES, start=1)
    ],
    _smell_rule("smell_sql", "High", scans.DYNAMIC_SQL),
    _smell_rule("smell_access", "High", scans.OPEN_ACCESS),
    _smell_rule("smell_reflection", "Medium", scans.REFLECTION),
]
# smells of a whole repository, worked out from the counts (M6, M7)
DENSITY = Rule(
    "smell_density", scans.SMELL, "", "High", "Density of Weak Cryptography", R.DESIGN_CATEGORY
)
CONCENTRATION = Rule(
    "smell_concentration", scans.SMELL, "", "High", "Concentrated Attack Surface Danger"
)
REPO_SMELLS = [DENSITY, CONCENTRATION]


def sum_of(rules) -> str:
    """SQL sum over the counts of the rules."""
    return " + ".join(rule.column for rule in rules) or "0L"


def rules_of(kind: str, severity: str | None = None, owasp: str | None = None) -> list[Rule]:
    return [
        rule
        for rule in [*RULES, *REPO_SMELLS]
        if rule.kind == kind
        and severity in (None, rule.severity)
        and owasp in (None, rule.owasp)
    ]


def tally_hits(hits: DataFrame, kinds=scans.ALL_KINDS) -> DataFrame:
    """One row per repository with hits, one count per rule of the kinds."""
    counts = [
        F.expr(f"count_if(kind = '{r.kind}' AND key = {quoted(r.key)})").alias(r.column)
        for r in RULES
        if r.kind in kinds
    ]
    return hits.groupBy("repo").agg(*counts)


def complete(repos: DataFrame, tallies: DataFrame) -> DataFrame:
    """Every repository, with zeros where it has no hits, and the repository smells."""
    names = [c for c in tallies.columns if c != "repo"]
    filled = (
        repos.select("repo")
        .join(tallies, "repo", "left")
        .selectExpr("repo", *[f"coalesce({n}, 0L) AS {n}" for n in names])
    )
    if set(r.column for r in RULES) <= set(names):
        return with_totals(filled)
    return filled


def with_totals(counts: DataFrame) -> DataFrame:
    """Adds the sums the reports use."""
    crypto = sum_of(rules_of(scans.DANGEROUS, owasp=R.CRYPTO_CATEGORY))
    base = counts.selectExpr(
        "*",
        f"{sum_of(rules_of(scans.SECRET))} AS n_secrets",
        f"{sum_of(rules_of(scans.DANGEROUS))} AS n_dangerous",
        *[
            f"{sum_of(rules_of(scans.DANGEROUS, name))} AS dangerous_{name.lower()}"
            for name in SEVERITIES
        ],
        f"{crypto} AS n_weak_crypto",
        f"CAST({crypto} >= {R.WEAK_CRYPTO_LIMIT} AS BIGINT) AS {DENSITY.column}",
        "CAST(file_uploads >= 2 AND rest_endpoints >= 5 AS BIGINT) "
        f"AS {CONCENTRATION.column}",
    )
    return base.selectExpr(
        "*",
        f"{sum_of(rules_of(scans.SMELL, 'High'))} AS smells_high",
        f"{sum_of(rules_of(scans.SMELL, 'Medium'))} AS smells_medium",
    )


# ---------------------------------------------------------------------------
# Attack surface
# ---------------------------------------------------------------------------


def surface_total() -> Column:
    return F.expr(" + ".join(SURFACES))


def _rating_branches():
    rest, auth = F.col("rest_endpoints"), F.col("auth_modules")
    db, uploads = F.col("db_access"), F.col("file_uploads")
    total = surface_total()
    return [
        (
            total == 0,
            "LOW",
            F.lit(
                "No major attack surface components detected (pure library or local utility)."
            ),
        ),
        (
            (rest >= 10) | ((rest >= 5) & (db >= 3)) | (uploads >= 3),
            "HIGH",
            F.format_string(
                "Significant attack surface detected with %d REST endpoints, "
                "%d database access points, and %d file uploads. Requires thorough review.",
                rest, db, uploads,
            ),
        ),
        (
            (rest >= 3) | (db >= 2) | (auth >= 2),
            "MEDIUM",
            F.format_string(
                "Moderate attack surface detected with %d REST endpoints, "
                "%d database access points, and %d authentication configurations.",
                rest, db, auth,
            ),
        ),
        (
            F.lit(True),
            "LOW",
            F.format_string(
                "Limited attack surface with only %d sensitive components identified.", total
            ),
        ),
    ]


def surface_rating() -> Column:
    rating = F
    for condition, name, _ in _rating_branches():
        rating = rating.when(condition, name)
    return rating


def surface_explanation() -> Column:
    text = F
    for condition, _, explanation in _rating_branches():
        text = text.when(condition, explanation)
    return text


def attack_surface(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Q9: files per category, all seven categories per repository."""
    counts = _surface_counts(repos, files)
    rows = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in SURFACES]
    )
    return counts.select("repo", F.inline(rows))


def attack_surface_rating(repos: DataFrame, files: DataFrame) -> DataFrame:
    """A1: total, rating and its explanation."""
    return _surface_counts(repos, files).select(
        "repo",
        surface_total().alias("total"),
        surface_rating().alias("rating"),
        surface_explanation().alias("explanation"),
    )


def _surface_counts(repos, files):
    hits = scans.scan_files(files, [scans.SURFACE])
    return complete(repos, tally_hits(hits, [scans.SURFACE]))


# ---------------------------------------------------------------------------
# Smells
# ---------------------------------------------------------------------------


def file_smells(hits: DataFrame) -> DataFrame:
    """M1-M5; W5 keeps one row per (title, file) of a repository."""
    return (
        hits.where(F.col("kind") == scans.SMELL)
        .select(
            "repo", "severity", F.col("key").alias("title"), F.col("text").alias("detail"),
            F.col("path").alias("file"),
        )
        .distinct()
    )


def smells(hits: DataFrame) -> DataFrame:
    """M0: file smells and the two smells of a whole repository, from one pass.

    A hit counts towards the rows it belongs to: a smell towards its own
    (title, file), weak cryptography and exposed surface towards a row of the
    repository, which is kept where its counts call for it.  A scan yields a smell
    once per file, so its texts can stand among the grouping keys and only numbers
    are aggregated.
    """
    crypto = [r.key for r in rules_of(scans.DANGEROUS, owasp=R.CRYPTO_CATEGORY)]
    kind, key = F.col("kind"), F.col("key")
    title = (
        F.when(kind == scans.SMELL, key)
        .when((kind == scans.DANGEROUS) & key.isin(crypto), DENSITY.title)
        .when(key.isin("file_uploads", "rest_endpoints"), CONCENTRATION.title)
    )
    grouped = (
        hits.withColumns(
            {
                "title": title,
                "file": F.when(kind == scans.SMELL, F.col("path")),
                "severity": F.when(kind == scans.SMELL, F.col("severity")),
                "detail": F.when(kind == scans.SMELL, F.col("text")),
            }
        )
        .where(F.col("title").isNotNull())
        .groupBy("repo", "title", "file", "severity", "detail")
        .agg(
            F.count("*").alias("n"),
            F.count_if(key == "file_uploads").alias("uploads"),
            F.count_if(key == "rest_endpoints").alias("endpoints"),
        )
    )
    own = F.col("file").isNotNull()
    dense = (F.col("title") == DENSITY.title) & (F.col("n") >= R.WEAK_CRYPTO_LIMIT)
    concentrated = (
        (F.col("title") == CONCENTRATION.title)
        & (F.col("uploads") >= 2)
        & (F.col("endpoints") >= 5)
    )
    detail = (
        F.when(own, F.col("detail"))
        .when(
            dense,
            F.format_string(
                R.SMELL_DETAILS[DENSITY.title],
                F.col("n"),
            ),
        )
        .otherwise(
            F.format_string(
                R.SMELL_DETAILS[CONCENTRATION.title],
                F.col("uploads"), F.col("endpoints"),
            )
        )
    )
    return grouped.where(own | dense | concentrated).select(
        "repo",
        F.when(own, F.col("severity")).otherwise("High").alias("severity"),
        "title",
        detail.alias("detail"),
        "file",
    )
