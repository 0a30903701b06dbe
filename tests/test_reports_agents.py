from pyspark.sql import functions as F

from forgelens.operators import agents, reports

REPORT = """intro
# Audit
## 1. Executive Summary
Global Technical Debt Score: 71/100
Code Quality Score: 0/40, Security Score: 12 / 30
Qualité 20/40
## Hotspots
CRITICAL HOTSPOT critical hotspot CVE-2024-12 cve-2023-1
### Security
first
## Hotspots
second
#### not a heading
"""


def _frame(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "repo string, text string")


def test_metrics(spark):
    row = reports.report_metrics(_frame(spark, REPORT)).first()
    assert (row["global"], row.quality, row.security, row.structure) == (71, 0, 12, None)
    assert (row.n_cve, row.n_critical_hotspot) == (2, 2)
    assert (row.global_band, row.quality_band, row.security_band) == ("good", "neutral", "warning")
    assert (row.structure_band, row.cve_band) == ("neutral", "critical")


def test_score_colors(spark):
    values = [(None,), (0,), (39,), (40,), (69,), (70,)]
    frame = spark.createDataFrame(values, "s int")
    found = [r[0] for r in frame.select(reports.score_color(F.col("s"))).collect()]
    assert found == ["neutral", "critical", "critical", "warning", "warning", "good"]


def test_sections(spark):
    rows = reports.report_sections(_frame(spark, REPORT, "no heading", "")).collect()
    first = [(r.section_pos, r.section, r.content) for r in rows if r.repo == "0"]
    assert first == [
        (0, "Audit", ""),
        (1, "1. Executive Summary",
         "Global Technical Debt Score: 71/100\nCode Quality Score: 0/40, "
         "Security Score: 12 / 30\nQualité 20/40"),
        (2, "Hotspots", "second\n#### not a heading"),
        (3, "Security", "first"),
    ]
    assert [r.section for r in rows if r.repo != "0"] == ["Full Report", "Full Report"]
    tabs = {r.tab: r.content for r in reports.report_tabs(_frame(spark, REPORT)).collect()}
    assert tabs["quality"] == "second\n#### not a heading" and tabs["security"] == "first"
    assert tabs["action"] == "" and tabs["summary"].startswith("Global")


def test_consistency(spark):
    scored = spark.createDataFrame(
        [("a", 26, 1, 0), ("b", 21, 0, 1), ("c", 19, 3, 0), ("d", 30, 0, 0)],
        "repo string, score int, dangerous_critical bigint, n_critical_cves bigint",
    )
    plan = spark.createDataFrame(
        [("a", "quality", "MINOR", 110), ("a", "security", "Critical", 205),
         ("b", "security", "Critical", 101), ("b", "quality", "CRITICAL", 115)],
        "repo string, source string, severity string, order_rank int",
    )
    spots = spark.createDataFrame(
        [("a", 1, "STABLE", "text"), ("b", 1, "STABLE", "")],
        "repo string, hotspot_score bigint, risk_level string, interpretation string",
    )
    rows = reports.report_consistency(scored, reports.plan_order(plan), spots).collect()
    found = {}
    for r in rows:
        found.setdefault(r.check, {})[r.repo] = r.status
    assert found == {
        "score_vs_findings": dict(a="inconsistent", b="reservation", c="ok", d="ok"),
        "priority_order": dict(a="inconsistent", b="ok", c="ok", d="ok"),
        "hotspot_section": dict(a="ok", b="reservation", c="reservation", d="reservation"),
    }


EVENTS = [
    ("s", 0, None, None, "short", False),
    ("s", 1, "scanner_agent", "read", None, False),
    ("s", 2, "scanner_agent", "list", "x" * 400, True),
    ("s", 3, "scanner_agent", "read", "y" * 50, True),
    ("s", 4, "x_orchestrator", None, "", True),
    ("s", 2500, "me", "read", "last words of the session", True),
]


def _events(spark):
    return spark.createDataFrame(
        EVENTS,
        "session string, seq bigint, author string, tool string, text string, is_final boolean",
    )


def test_timeline(spark):
    rows = {r.author: r for r in agents.agent_timeline(_events(spark)).collect()}
    scanner = rows["scanner_agent"]
    assert (scanner.first_seq, scanner.event_count, scanner.label) == (1, 3, "Scanner Agent")
    assert scanner.text_preview == "x" * 300
    assert rows["unknown"].text_preview is None and rows["me"].label == "me"
    assert rows["x_orchestrator"].label == "x_orchestrator"
    named = _events(spark).select(agents.author_label(F.col("author"), [("me", "Myself")]).alias("l"))
    assert "Myself" in {r.l for r in named.collect()}


def test_tools_in_first_seen_order(spark):
    rows = {r.author: (r.tools, r.event_count) for r in agents.agent_tools(_events(spark)).collect()}
    assert rows == {
        "scanner_agent": ("read,list", 3), "unknown": ("", 1), "x_orchestrator": ("", 1),
        "me": ("read", 1),
    }


def test_transcript(spark):
    rows = agents.session_transcript(_events(spark)).orderBy("seq").collect()
    lines = ["x" * 400, "y" * 50, "last words of the session"]
    assert [r.text for r in rows] == lines
    (joined,) = agents.joined_transcript(_events(spark)).collect()
    assert joined.text == "\n".join(lines)
