"""Content scans: secrets, dangerous APIs, attack surface and file-level smells.

Every scan is a projection over one file row followed by ``inline``: no
shuffle, no join, one read of ``content`` however many scans are asked for.
Memory is bounded by a single file, and a repository that holds a third of all
files is simply spread over more tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import registries as R
from ..functions import text as T

SECRET, DANGEROUS, SURFACE, SMELL = "secret", "dangerous", "surface", "smell"
ALL_KINDS = (SECRET, DANGEROUS, SURFACE, SMELL)
DEPENDENCY = "dependency"  # lines of dependency files, read in the same pass
LINES = "lines"  # the number of lines, as one row of every text
HIT_ARRAY = "array<struct<kind:string,key:string,severity:string,lineno:bigint,text:string>>"

GOD_OBJECT = "God Security Object"
LEGACY_ENGINE = "Legacy Template Engine: "
DYNAMIC_SQL = "Dynamic SQL Construction"
OPEN_ACCESS = "Disabled Security Access Control"
REFLECTION = "Excessive Reflection Usage"


def scan_files(
    files: DataFrame,
    kinds=ALL_KINDS,
    applies=None,
    strict_mask=False,
    specs: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One pass over ``files(repo, path, content)``; one row per hit.

    Result: repo, path, kind, key, severity, lineno, text.  ``applies`` maps a
    kind to a condition on the file, for kinds that cover fewer files than the
    input holds.  ``specs`` is the array of requirement lines of a dependency file, for
    the kind of these, which needs a condition.  ``keep`` names further columns of
    ``files`` for the result, after the path.
    """
    applies = applies or {}
    conditions = [c.alias(f"_on_{kind}") for kind, c in applies.items()]
    texts = files.where("content <> ''").select("repo", "path", *keep, "content", *conditions)
    flagged = _with_line_flags(G.with_guard_columns(texts), kinds, applies)
    builders = {
        SECRET: lambda: _secret_hits(strict_mask),
        DANGEROUS: _dangerous_hits,
        SURFACE: _surface_hits,
        SMELL: _smell_hits,
        DEPENDENCY: lambda: _dependency_hits(specs),
        LINES: _line_number_hits,
    }
    parts = []
    for kind in kinds:
        hits = builders[kind]()
        if kind in applies and kind in (SURFACE, SMELL, DEPENDENCY):
            hits = F.when(F.col(f"_on_{kind}"), hits)
        parts.append(F.coalesce(hits, F.array().cast(HIT_ARRAY)))
    all_hits = F.concat(*parts) if len(parts) > 1 else parts[0]
    return flagged.select("repo", "path", *keep, F.inline(all_hits))


def applies_by_flag(kinds=ALL_KINDS) -> dict:
    """Kinds of hits by the flag of the selection they cover: for_secrets or for_deep."""
    return {k: F.col("for_secrets" if k == SECRET else "for_deep") for k in kinds}


def _with_line_flags(texts: DataFrame, kinds, applies) -> DataFrame:
    """Adds whether each line rule can match, and the lines where any of them can."""
    flags = {}
    if SECRET in kinds:
        flags |= {
            f"_s{i}": G.found(pattern, "", G.SECRET_GUARDS[name])
            for i, (name, pattern) in enumerate(R.SECRET_PATTERNS)
        }
        if SECRET in applies:
            flags = {name: f"_on_{SECRET} AND {test}" for name, test in flags.items()}
    if DANGEROUS in kinds:
        on = f"_on_{DANGEROUS} AND " if DANGEROUS in applies else ""
        texts = texts.withColumn("_language", T.language(F.col("path")))
        flags |= {
            f"_d{i}": f"{on}_language = '{rule[1]}' AND "
            + G.found(G.WHOLE_TEXT_REGEX.get(rule[0], rule[2]), "im", G.DANGEROUS_GUARDS[rule[0]])
            for i, rule in enumerate(R.DANGEROUS_PATTERNS)
        }
    if not flags:
        return texts
    flagged = texts.selectExpr("*", *[f"({test}) AS {name}" for name, test in flags.items()])
    return flagged.withColumn(
        "_lines", F.when(F.expr(" OR ".join(flags)), T.raw_lines(F.col("content")))
    )


def _any_secret() -> str:
    return " OR ".join(f"_s{i}" for i in range(len(R.SECRET_PATTERNS)))


def _hit(kind, key, severity, lineno, text) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        key.alias("key"),
        severity.alias("severity"),
        lineno.cast("bigint").alias("lineno"),
        text.alias("text"),
    )


def _secret_hits(strict_mask: bool) -> Column:
    """At most one hit per line: the first pattern of the registry that matches."""
    cases = " ".join(
        f"WHEN _s{i} AND line RLIKE {T.quoted(T.regex(pattern))} THEN {T.quoted(name)}"
        for i, (name, pattern) in enumerate(R.SECRET_PATTERNS)
    )
    matching = F.expr(
        "filter(transform(_lines, (line, i) -> "
        f"struct(CASE {cases} END AS name, i + 1 AS lineno, line AS line)), "
        "found -> found.name IS NOT NULL)"
    )

    def shown(found):
        if strict_mask:
            patterns = [pattern for _, pattern in R.SECRET_PATTERNS]
            text = T.strictly_masked_snippet(found["line"], patterns)
        else:
            text = T.masked_snippet(found["line"])
        none = F.lit(None).cast("string")
        return _hit(SECRET, found["name"], none, found["lineno"], text)

    return F.when(F.expr(_any_secret()), F.transform(matching, shown))


def _dangerous_hits() -> Column:
    """First matching line per rule of the file's language."""
    candidates = ", ".join(
        f"CASE WHEN _d{i} THEN struct('{identifier}' AS id, '{severity}' AS severity, "
        "array_position(transform(_lines, "
        f"line -> line RLIKE {T.quoted(T.regex(pattern, 'im'))}), true) AS lineno) END"
        for i, (identifier, _, pattern, severity, *_) in enumerate(R.DANGEROUS_PATTERNS)
    )
    on_a_line = F.expr(f"filter(array({candidates}), p -> p.lineno > 0)")
    return F.transform(
        on_a_line,
        lambda p: _hit(
            DANGEROUS,
            p["id"],
            p["severity"],
            p["lineno"],
            T.snippet(F.get(F.col("_lines"), (p["lineno"] - 1).cast("int")), 160),
        ),
    )


def _surface_hits() -> Column:
    categories = ", ".join(
        f"CASE WHEN {G.in_category(name)} THEN '{name}' END" for name in R.ATTACK_SURFACE_PATTERNS
    )
    none = F.lit(None).cast("string")
    return F.transform(
        F.expr(f"filter(array({categories}), c -> c IS NOT NULL)"),
        lambda category: _hit(SURFACE, category, none, F.lit(None), none),
    )


def _dependency_hits(specs: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(
        specs, lambda line, i: _hit(DEPENDENCY, F.col("path"), none, i, line)
    )


def _line_number_hits() -> Column:
    none = F.lit(None).cast("string")
    return F.array(_hit(LINES, none, none, T.line_count(F.col("content")), none))


def _smell_hits() -> Column:
    path, content = F.col("path"), F.col("content")

    def smell(condition, severity, title, detail):
        return F.when(
            condition, _hit(SMELL, title, F.lit(severity), F.lit(None), detail)
        )

    size = T.line_count(content)
    engines = " ".join(
        f"WHEN {G.found(pattern, 'i', G.LEGACY_ENGINE_GUARDS[name])} THEN '{name}'"
        for pattern, name in R.LEGACY_ENGINES
    )
    engine = F.expr(f"CASE {engines} END")
    reflections = T.mentions(content, R.REFLECTION_REGEX, "")
    candidates = F.array(
        smell(
            T.contains_any(F.lower(path), R.SECURITY_PATH_KEYWORDS)
            & (size > R.GOD_OBJECT_LINES),
            "Medium",
            F.lit(GOD_OBJECT),
            F.format_string(
                R.SMELL_DETAILS[GOD_OBJECT],
                path, size,
            ),
        ),
        smell(
            engine.isNotNull(),
            "Medium",
            F.concat(F.lit(LEGACY_ENGINE), engine),
            F.format_string(
                R.SMELL_DETAILS[LEGACY_ENGINE],
                engine, path,
            ),
        ),
        smell(
            F.expr(G.found(R.DYNAMIC_SQL_REGEX, "i", G.DYNAMIC_SQL_GUARD)),
            "High",
            F.lit(DYNAMIC_SQL),
            F.format_string(
                R.SMELL_DETAILS[DYNAMIC_SQL],
                path,
            ),
        ),
        smell(
            F.expr(G.found(R.PERMIT_ALL_REGEX, "", G.PERMIT_ALL_GUARD)),
            "High",
            F.lit(OPEN_ACCESS),
            F.format_string(
                R.SMELL_DETAILS[OPEN_ACCESS],
                path,
            ),
        ),
        smell(
            F.expr(G.possible(G.REFLECTION_GUARD)) & (reflections >= R.REFLECTION_LIMIT),
            "Medium",
            F.lit(REFLECTION),
            F.format_string(
                R.SMELL_DETAILS[REFLECTION],
                reflections, path,
            ),
        ),
    )
    return F.filter(candidates, lambda hit: hit.isNotNull())


# ---------------------------------------------------------------------------
# Single scans
# ---------------------------------------------------------------------------


def secret_scan(files: DataFrame, strict_mask: bool = False) -> DataFrame:
    """K1: repo, path, lineno, pattern, snippet."""
    return secret_findings(scan_files(files, [SECRET], strict_mask=strict_mask))


def secret_findings(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("kind") == SECRET).select(
        "repo", "path", "lineno", F.col("key").alias("pattern"), F.col("text").alias("snippet")
    )


def secret_counts(files: DataFrame) -> DataFrame:
    """Findings per file, files without a finding included; stays map-only."""
    texts = files.selectExpr("repo", "path", "coalesce(content, '') AS content")
    flagged = _with_line_flags(G.with_guard_columns(texts), [SECRET], {})
    matches = " OR ".join(
        f"(_s{i} AND line RLIKE {T.quoted(T.regex(pattern))})"
        for i, (_, pattern) in enumerate(R.SECRET_PATTERNS)
    )
    return flagged.selectExpr(
        "repo",
        "path",
        f"CAST(CASE WHEN {_any_secret()} THEN size(filter(_lines, line -> {matches})) "
        "ELSE 0 END AS BIGINT) AS finding_count",
    )


def dangerous_scan(files: DataFrame) -> DataFrame:
    """K2: one row per (file, rule) with the rule's texts."""
    return dangerous_findings(scan_files(files, [DANGEROUS]))


def rule_texts(rule_id: Column) -> Column:
    """Title, risk, remediation and category of a rule, from a constant map."""
    entries = ", ".join(
        f"'{identifier}', named_struct('title', {T.quoted(title)}, 'risk', {T.quoted(risk)}, "
        f"'remediation', {T.quoted(remediation)}, 'owasp', {T.quoted(owasp)})"
        for identifier, _, _, _, title, risk, remediation, owasp in R.DANGEROUS_PATTERNS
    )
    return F.expr(f"map({entries})")[rule_id]


def dangerous_findings(hits: DataFrame) -> DataFrame:
    found = hits.where(F.col("kind") == DANGEROUS)
    return found.withColumn("_rule", rule_texts(F.col("key"))).select(
        "repo",
        F.col("key").alias("id"),
        F.col("path").alias("file"),
        F.col("lineno").alias("line"),
        "severity",
        "_rule.title",
        "_rule.risk",
        "_rule.remediation",
        "_rule.owasp",
        F.col("text").alias("snippet"),
    )


def attack_surface_hits(files: DataFrame) -> DataFrame:
    """Repo, category, path; one row per category a file belongs to."""
    return surface_hits(scan_files(files, [SURFACE]))


def surface_hits(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("kind") == SURFACE).select(
        "repo", F.col("key").alias("category"), "path"
    )
