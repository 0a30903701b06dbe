"""Text analytics over Markdown audit reports, and consistency checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registries as R
from ..functions import text as T

FULL_REPORT = "Full Report"


def score_in(text: Column, pattern: str) -> Column:
    """first integer the pattern finds, null without one."""
    return F.regexp_extract(text, T.regex(pattern, "i"), 1).try_cast("int")


def score_color(score: Column) -> Column:
    """neutral without a score, else critical, warning or good."""
    return (
        F.when(score.isNull(), "neutral")
        .when(score < 40, "critical")
        .when(score < 70, "warning")
        .otherwise("good")
    )


def percent_of(score: Column, denominator: int) -> Column:
    """Whole percent; a score of 0 counts as no score."""
    return F.when(score != 0, (score / denominator * 100).cast("int"))


def report_metrics(reports: DataFrame) -> DataFrame:
    """The four scores with their colours, and the two mention counts."""
    text = F.col("text")
    scored = reports.select(
        "repo",
        *[score_in(text, pattern).alias(name) for name, pattern, _ in R.REPORT_SCORES],
        T.mentions(text, R.CVE_MENTION_REGEX).alias("n_cve"),
        T.mentions(text, R.HOTSPOT_MENTION_REGEX).alias("n_critical_hotspot"),
    )
    bands = {}
    for name, _, denominator in R.REPORT_SCORES:
        score = F.col(name)
        shown = score if denominator == 100 else percent_of(score, denominator)
        bands[f"{name}_band"] = score_color(shown)
    bands["cve_band"] = F.when(F.col("n_cve") > 0, "critical").otherwise("good")
    return scored.withColumns(bands)


def sections_of(text: Column) -> Column:
    """Array of (heading, content) of one report, inside its row.

    Text before the first heading is dropped.  A repeated heading keeps its
    first place and takes its last content; a report without headings is one
    section.
    """
    heading = T.regex(R.HEADING_REGEX, "m")
    titles = F.transform(F.regexp_extract_all(text, F.lit(heading), 1), T.strip)
    bodies = F.transform(F.slice(F.split(text, heading), 2, 1_000_000_000), T.strip)
    whole = F.array(F.struct(F.lit(FULL_REPORT).alias("section"), text.alias("content")))

    def sections(found):
        last = lambda title: (
            F.size(found["titles"]) - F.array_position(F.reverse(found["titles"]), title)
        )
        listed = F.transform(
            F.array_distinct(found["titles"]),
            lambda title: F.struct(
                title.alias("section"),
                F.get(found["bodies"], last(title).cast("int")).alias("content"),
            ),
        )
        return F.when(F.size(found["titles"]) == 0, whole).otherwise(listed)

    # the outer array binds the two arrays, which would be worked out anew for
    # every title if the inner lambda named them directly
    found = F.array(F.struct(titles.alias("titles"), bodies.alias("bodies")))
    return F.get(F.transform(found, sections), F.lit(0))


def report_sections(reports: DataFrame) -> DataFrame:
    """Repo, section_pos, section, content."""
    return reports.select(
        "repo", F.posexplode(sections_of(F.col("text"))).alias("section_pos", "_s")
    ).select("repo", "section_pos", "_s.section", "_s.content")


def report_tabs(reports: DataFrame) -> DataFrame:
    """F16: per tab the content of the first section whose heading has a keyword."""
    sectioned = reports.select("repo", sections_of(F.col("text")).alias("_sections"))
    tabs = F.array(*[_tab(tab, keywords) for tab, keywords in R.REPORT_TABS])
    return sectioned.select("repo", F.inline(tabs))


def _tab(tab: str, keywords: list[str]) -> Column:
    hits = F.filter("_sections", lambda s: T.contains_any(F.lower(s["section"]), keywords))
    content = F.coalesce(F.get(hits, F.lit(0))["content"], F.lit(""))
    return F.struct(F.lit(tab).alias("tab"), content.alias("content"))


# ---------------------------------------------------------------------------
# Consistency of the computed audit (the deterministic part of a review)
# ---------------------------------------------------------------------------

OK, INCONSISTENT, RESERVATION = "ok", "inconsistent", "reservation"


def plan_order(plan: DataFrame) -> DataFrame:
    """First place of a quality action and last place of a Critical security one."""
    critical = (F.col("source") == "security") & (F.col("severity") == "Critical")
    return plan.groupBy("repo").agg(
        F.min(F.when(F.col("source") == "quality", F.col("order_rank"))).alias("first_quality"),
        F.max(F.when(critical, F.col("order_rank"))).alias("last_critical"),
    )


def report_consistency(scored: DataFrame, order: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Repo, check, status.

    * score_vs_findings: a Critical finding asks for a score below 20; 25 and
      more beside one is an inconsistency.
    * priority_order: no code-quality action before a Critical security one
      (``order`` from :func:`plan_order`).
    * hotspot_section: at least one file with score, level and sentence.
    """
    integrity = hotspots.groupBy("repo").agg(
        F.bool_and(
            F.col("hotspot_score").isNotNull()
            & F.col("risk_level").isNotNull()
            & (F.col("interpretation") != "")
        ).alias("_complete")
    )
    critical = (F.col("dangerous_critical") + F.col("n_critical_cves")) > 0
    score, early = F.col("score"), F.col("first_quality") < F.col("last_critical")
    check = lambda name, status: F.struct(
        F.lit(name).alias("check"), status.alias("status")
    )
    checks = F.array(
        check(
            "score_vs_findings",
            F.when(critical & (score >= 25), INCONSISTENT)
            .when(critical & (score >= 20), RESERVATION)
            .otherwise(OK),
        ),
        check("priority_order", F.when(early, INCONSISTENT).otherwise(OK)),
        check("hotspot_section", F.when(F.col("_complete"), OK).otherwise(RESERVATION)),
    )
    return (
        scored.join(order, "repo", "left")
        .join(integrity, "repo", "left")
        .select("repo", F.inline(checks))
    )
