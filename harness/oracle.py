"""The registered queries once more as plain SQL over the driver's tables.

``CTES`` are named building blocks; :func:`sql` puts those a query mentions in
front of it.  Regular expressions and texts come from the registries, the logic
is written anew.
"""

import re

from forgelens.functions import registries as R

from . import snippets as S


def text(value: str) -> str:
    """An SQL string; control characters as chr(n)."""
    pieces = re.split(r"([\x00-\x1f])", value)
    parts = []
    for piece in pieces:
        if len(piece) == 1 and piece < " ":
            parts.append(f"chr({ord(piece)})")
        elif piece or len(pieces) == 1:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def pick(values, number="doc_id") -> str:
    return f"([{', '.join(text(v) for v in values)}])[{number} % {len(values)} + 1]"


def has(column: str, pattern: str, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_matches({column}, {text(prefix + pattern)})"


def any_has(column: str, patterns, flags: str = "") -> str:
    return "(" + " OR ".join(has(column, p, flags) for p in patterns) + ")"


WS = " || ".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160))
BREAK = text("\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]")


def strip(column: str) -> str:
    return f"trim({column}, {WS})"


def lines_of(source: str, columns: str = "repo, path") -> str:
    return (
        f"SELECT {columns}, unnest(l) AS line, generate_subscripts(l, 1) AS lineno FROM "
        f"(SELECT {columns}, string_split_regex(content, {BREAK}) AS l FROM {source})"
    )


STEM = (
    "(CASE doc_id % 31 WHEN 3 THEN 'p' || doc_id || '/__init__' WHEN 4 THEN 'config_' || doc_id "
    "WHEN 6 THEN 'latest_' || doc_id ELSE 'mod_' || doc_id END)"
)
NUM = "CAST(regexp_extract(repo, '([0-9]+)$', 1) AS INTEGER)"
VERSION_I = f"((i % 6) || '.' || ((i + {NUM}) % 10))"
OWN = "lower(path) NOT LIKE '%test%' AND path NOT LIKE '%.venv%' AND path NOT LIKE '%vendor%'"
SECRET_OK = f"kind = 'blob' AND path LIKE '%.py' AND {OWN}"
DEEP_OK = (
    "kind = 'blob' AND ("
    + " OR ".join(f"ends_with(path, '{e}')" for e in R.DEEP_EXTENSIONS)
    + f") AND {OWN} AND path NOT LIKE '%node_modules%'"
)
LANGUAGE = (
    "CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.java') OR "
    "ends_with(path, '.kt') OR ends_with(path, '.groovy') THEN 'java' ELSE 'any' END"
)
DEPTH = "length(path) - length(replace(path, '/', ''))"


def version_key(v: str) -> str:
    return (
        f"list_transform(string_split(regexp_replace({v}, '(\\.0*)+$', ''), '.'), "
        "lambda x: coalesce(try_cast(x AS BIGINT), 0))"
    )


def dotted(n: str) -> str:
    return f"(({n}) // 10) || '.' || (({n}) % 10) || '.0'"


def secret_rows(files: str) -> str:
    first = "CASE " + " ".join(
        f"WHEN {has('line', p)} THEN {text(n)}" for n, p in R.SECRET_PATTERNS
    ) + " END"
    return (
        f"SELECT repo, path, lineno, pattern, substring(regexp_replace({strip('line')}, "
        f"{text(chr(91) + chr(39) + chr(34) + ']' + '[^' + chr(39) + chr(34) + ']{4,}[' + chr(39) + chr(34) + ']')}, "
        f"'''***MASKED***''', 'g'), 1, 200) AS snippet "
        f"FROM (SELECT repo, path, lineno, line, {first} AS pattern FROM ({lines_of(files)})) "
        "WHERE pattern IS NOT NULL"
    )


def dangerous_match(identifier: str, pattern: str) -> str:
    if identifier == "PY-005":  # RE2 has no look-ahead
        return (
            f"({has('line', 'yaml[.]load[ ]*[(][^)]*[)]', 'i')} AND NOT "
            f"{has('line', 'yaml[.]load[ ]*[(][^)]*[)].*Loader[ ]*=[ ]*yaml[.]SafeLoader', 'i')})"
        )
    return has("line", pattern, "im")


def dangerous_rows(lines: str) -> str:
    """First line per (file, rule); ``lines`` is a materialised CTE with a language."""
    rules = []
    for identifier, language, pattern, severity, title, _, _, owasp in R.DANGEROUS_PATTERNS:
        rules.append(
            f"SELECT repo, path, '{identifier}' AS id, '{severity}' AS severity, "
            f"{text(title)} AS title, '{owasp}' AS owasp, min(lineno) AS line, "
            f"substring({strip('arg_min(line, lineno)')}, 1, 160) AS snippet FROM {lines} "
            f"WHERE language = '{language}' AND {dangerous_match(identifier, pattern)} "
            "GROUP BY repo, path"
        )
    return " UNION ALL ".join(rules)


def surface_rows(files: str) -> str:
    return " UNION ALL ".join(
        f"SELECT repo, '{category}' AS category, path FROM {files} "
        f"WHERE content <> '' AND {any_has('content', patterns, 'im')}"
        for category, patterns in R.ATTACK_SURFACE_PATTERNS.items()
    )


SURFACES = list(R.ATTACK_SURFACE_PATTERNS)
N_LINES = (
    f"(len(string_split_regex(content, {BREAK})) - "
    f"CASE WHEN {has('content', '(?:' + BREAK[1:-1] + ')$')} THEN 1 ELSE 0 END)"
)


def filled(template: str, values: list[str]) -> str:
    """A text with SQL expressions in place of its %s and %d."""
    pieces = re.split("%[sd]", template)
    parts = [text(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [f"CAST(({value}) AS VARCHAR)", text(piece)]
    return "(" + " || ".join(parts) + ")"


def smell_rows(files: str) -> str:
    keyword = " OR ".join(f"contains(lower(path), '{k}')" for k in R.SECURITY_PATH_KEYWORDS)
    engine = "CASE " + " ".join(
        f"WHEN {has('content', p, 'i')} THEN '{n}'" for p, n in R.LEGACY_ENGINES
    ) + " END"
    reflections = f"len(regexp_extract_all(content, {text(R.REFLECTION_REGEX)}))"
    shown = {
        "God Security Object": ["path", N_LINES], "Legacy Template Engine: ": [engine, "path"],
        "Excessive Reflection Usage": [reflections, "path"],
    }

    def one(severity, title, condition):
        name = title.split("'")[1]
        return (
            f"SELECT repo, '{severity}' AS severity, {title} AS title, path AS file, "
            f"{filled(R.SMELL_DETAILS[name], shown.get(name, ['path']))} AS detail "
            f"FROM {files} WHERE content <> '' AND {condition}"
        )

    return " UNION ALL ".join(
        [
            one("Medium", "'God Security Object'", f"({keyword}) AND {N_LINES} > 500"),
            one("Medium", f"'Legacy Template Engine: ' || {engine}", f"{engine} IS NOT NULL"),
            one("High", "'Dynamic SQL Construction'", has("content", R.DYNAMIC_SQL_REGEX, "i")),
            one(
                "High",
                "'Disabled Security Access Control'",
                has("content", R.PERMIT_ALL_REGEX),
            ),
            one(
                "Medium",
                "'Excessive Reflection Usage'",
                f"len(regexp_extract_all(content, {text(R.REFLECTION_REGEX)})) >= 3",
            ),
        ]
    )


def surface_pivot(rows: str) -> str:
    return (
        "SELECT repo, "
        + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in SURFACES)
        + f" FROM {rows} GROUP BY repo"
    )


REPO_SURFACES = ", ".join(f"coalesce({c}, 0) AS {c}" for c in SURFACES)
TOTAL = "(" + " + ".join(SURFACES) + ")"
IS_HIGH = "rest_endpoints >= 10 OR (rest_endpoints >= 5 AND db_access >= 3) OR file_uploads >= 3"
IS_MEDIUM = "rest_endpoints >= 3 OR db_access >= 2 OR auth_modules >= 2"
RATING = (
    f"CASE WHEN {TOTAL} = 0 THEN 'LOW' WHEN {IS_HIGH} THEN 'HIGH' "
    f"WHEN {IS_MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END"
)


def severity_of(name_of_score: str) -> str:
    return (
        f"CASE WHEN {name_of_score} >= 9 THEN 'Critical' WHEN {name_of_score} >= 7 THEN 'High' "
        f"WHEN {name_of_score} >= 4 THEN 'Medium' WHEN {name_of_score} IS NOT NULL THEN 'Low' "
        "WHEN p_partkey % 97 > 2 AND p_partkey % 6 = 1 THEN 'High' "
        "WHEN p_partkey % 97 > 2 AND p_partkey % 6 = 3 THEN 'Medium' "
        "ELSE 'Unknown' END"
    )


RANK = (
    "CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 "
    "WHEN 'Low' THEN 4 ELSE 5 END"
)


def requirement(source: str) -> str:
    name = "'^([a-zA-Z0-9_.-]+)'"
    full = "'^([a-zA-Z0-9_.-]+)\\s*([><=!~^]{1,2})\\s*([0-9.*]+)'"
    return (
        f"SELECT *, regexp_extract(spec, {name}, 1) AS package, "
        f"CASE WHEN regexp_extract(spec, {full}, 2) IN ('==', '~=') "
        f"THEN regexp_extract(spec, {full}, 3) END AS version FROM ("
        f"SELECT *, regexp_replace({strip('line')}, '\\[.*?\\]', '', 'g') AS spec, "
        f"{strip('line')} AS bare FROM {source}) WHERE bare <> '' AND bare NOT LIKE '#%' "
        f"AND bare NOT LIKE '-%' AND regexp_matches(spec, {name})"
    )


def matched(deps: str) -> str:
    key = version_key("d.version")
    return (
        f"SELECT d.*, a.id, a.severity, a.summary, a.published FROM {deps} d "
        "JOIN rated a ON a.package = d.package AND ("
        "d.version IS NULL OR d.version LIKE '%*%' OR d.version = a.listed OR ("
        f"{version_key('a.introduced')} <= {key} AND "
        f"(a.fixed IS NULL OR {key} < {version_key('a.fixed')})))"
    )


LF = "chr(10)"
DOC_LINES = (
    "SELECT DISTINCT repo, path, s FROM (SELECT repo, path, "
    f"{strip('line')} AS s FROM ({lines_of('text_files')})) WHERE s <> ''"
)
BRANCHES = "(regexp_extract({0}, {1}, 1))"


def score_in(pattern: str) -> str:
    return f"try_cast(regexp_extract(text, {text('(?i)' + pattern)}, 1) AS INTEGER)"


def band(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN 'neutral' WHEN {value} < 40 THEN 'critical' "
        f"WHEN {value} < 70 THEN 'warning' ELSE 'good' END"
    )


def percent(name: str, of: int) -> str:
    return f"(CASE WHEN {name} <> 0 THEN CAST(floor({name} / {of}.0 * 100) AS INTEGER) END)"


def report_score(label: str, n: int, of: str) -> str:
    return f"'- {label} Score: ' || (doc_id % {n}) || '{of}' || {LF}"


CTES = {
    "code_blobs": f"""
        SELECT source AS repo, {pick(S.DIRECTORIES)} || {STEM} || {pick(S.EXTENSIONS)} AS path,
               'blob' AS kind,
               (CASE WHEN doc_id % 29 = 5 THEN repeat('x = 1' || {LF}, 600) ELSE '' END)
               || {pick(S.WEB)} || {LF} || {pick(S.SECRETS)} || {LF} || {pick(S.CODE)} || {LF}
               || text AS content
        FROM documents""",
    "repo_names": "SELECT DISTINCT source AS repo FROM documents",
    "requirement_texts": f"""
        SELECT repo, specs, '# generated' || {LF} || {LF} || '-r base.txt' || {LF} ||
                 array_to_string(specs, {LF}) || {LF} AS content,
               {text(S.PYPROJECT_HEAD)} || array_to_string(list_transform(specs, lambda s: '    "' || s || '",'), {LF})
                 || {LF} || {text(S.PYPROJECT_TAIL)} AS project FROM (
        SELECT repo, list_transform(range(0, 25), lambda i: 'pkg' || (({NUM} * 7 + i * 13) % 200) ||
                 (CASE i % 6 WHEN 0 THEN '==' || {VERSION_I} WHEN 1 THEN '>=' || {VERSION_I}
                  WHEN 2 THEN '[extra]~=' || {VERSION_I} WHEN 3 THEN ' == ' || {VERSION_I} || '  # note'
                  WHEN 4 THEN '==' || i || '.*' ELSE '' END)) AS specs
        FROM repo_names)""",
    "root_files": f"""
        SELECT r.repo, f.path, 'blob' AS kind, CASE f.path WHEN 'pyproject.toml' THEN r.project
          ELSE r.content END AS content, CASE f.path WHEN 'pyproject.toml'
          THEN array_to_string(r.specs, {LF}) ELSE r.content END AS spec_lines FROM requirement_texts r,
        (VALUES ('requirements.txt', 2, 0), ('package.json', 3, 0), ('pom.xml', 5, 0),
                ('pyproject.toml', 4, 1)) f(path, m, rest)
        WHERE {NUM.replace('repo', 'r.repo')} % f.m = f.rest""",
    "files": f"""
        SELECT *, CAST(strlen(content) AS BIGINT) AS size_bytes FROM (
          SELECT * FROM code_blobs UNION ALL SELECT repo, path, kind, content FROM root_files UNION ALL
          SELECT DISTINCT source, rtrim({pick(S.DIRECTORIES)}, '/'), 'tree', '' FROM documents
          WHERE {pick(S.DIRECTORIES)} <> '')""",
    "repos": f"""
        SELECT repo, 'main' AS default_branch, {NUM} * 10 AS stars,
               CASE WHEN {NUM} % 2 = 0 THEN 'Python' ELSE 'Java' END AS language FROM repo_names""",
    "py_files": f"""
        SELECT source AS repo, {pick(S.DIRECTORIES)} || {STEM} || '.py' AS path, 'blob' AS kind,
               {pick(S.PYTHON)} || {LF} || '# ' || replace(text, {LF}, {LF} || '# ') AS content,
               doc_id % {len(S.PYTHON)} AS snippet
        FROM documents""",
    "text_files": "SELECT lang AS repo, 'doc_' || doc_id || '.txt' AS path, text AS content FROM documents",
    "golden": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({s}, '{n}', '{k}', {p}, {ln}, {length}, {c}, {'NULL' if d is None else str(d).upper()})"
        for s, n, k, p, ln, length, c, d in S.PYTHON_BLOCKS
    )
    + ") g(snippet, name, kind, block_pos, lineno, length, complexity, has_docstring)",
    "blocks": "SELECT f.repo, f.path, g.* EXCLUDE (snippet) FROM py_files f JOIN golden g USING (snippet)",
    "max_complexities": """
        SELECT f.repo, f.path, CAST(coalesce(max(complexity), 1) AS INTEGER) AS max_complexity,
               arg_max(name, complexity * 1000 - block_pos) AS function_name,
               CAST(arg_max(lineno, complexity * 1000 - block_pos) AS INTEGER) AS function_lineno
        FROM py_files f LEFT JOIN blocks b ON b.repo = f.repo AND b.path = f.path
             AND b.kind <> 'nested'
        GROUP BY f.repo, f.path""",
    "doc_ratios": f"""
        SELECT f.repo, f.path,
          CASE WHEN NOT bad THEN n END AS total_functions,
          CASE WHEN NOT bad THEN d END AS documented_functions,
          CASE WHEN NOT bad AND n > 0 THEN round_even(d / n * 100, 1) END AS documentation_ratio,
          bad AS has_error
        FROM (SELECT f.repo, f.path, f.snippet IN ({', '.join(map(str, S.PYTHON_ERRORS))}) AS bad,
                count(b.name) AS n, count(b.name) FILTER (WHERE has_docstring) AS d
              FROM py_files f LEFT JOIN blocks b ON b.repo = f.repo AND b.path = f.path
                AND b.kind <> 'class' GROUP BY ALL) f""",
    "markers": """
        SELECT repo, path, CAST((length(content) - length(replace(content, 'TODO', ''))) / 4 AS BIGINT) AS todo,
          CAST((length(content) - length(replace(content, 'FIXME', ''))) / 5 AS BIGINT) AS fixme,
          CAST((length(content) - length(replace(content, 'XXX', ''))) / 3 AS BIGINT) AS xxx
        FROM py_files""",
    "commits": f"""
        SELECT d.source AS repo, {pick(S.DIRECTORIES)} || {STEM} || '.py' AS path, event_id AS sha,
               ts AS author_date, event_type AS message
        FROM events JOIN documents d ON d.doc_id = user_id""",
    "churn": """
        SELECT repo, path, count(*) AS commit_count, max(author_date) AS last_modified
        FROM commits WHERE author_date BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 90 DAY
          AND TIMESTAMP '2024-01-31' GROUP BY repo, path""",
    "hot": """
        SELECT m.*, coalesce(c.commit_count, 0) AS commit_count, c.last_modified,
               m.max_complexity * coalesce(c.commit_count, 0) AS hotspot_score
        FROM max_complexities m LEFT JOIN churn c ON c.repo = m.repo AND c.path = m.path""",
    "dep_lines": """
        SELECT 'supplier' || l_suppkey AS repo, 'requirements.txt' AS dep_file,
          l_orderkey * 10 + l_linenumber AS pos,
          CASE l_linenumber % 7
            WHEN 0 THEN 'pkg' || l_partkey || '==' || (CAST(floor(l_quantity) AS INTEGER) % 6) || '.' || (l_orderkey % 10) || '.0'
            WHEN 1 THEN 'pkg' || l_partkey || '>=' || (CAST(floor(l_quantity) AS INTEGER) % 6) || '.' || (l_orderkey % 10)
            WHEN 2 THEN 'pkg' || l_partkey || '[extra]~=' || (CAST(floor(l_quantity) AS INTEGER) % 6) || '.' || (l_orderkey % 10)
            WHEN 3 THEN 'pkg' || l_partkey
            WHEN 4 THEN '# pkg' || l_partkey || '==' || (CAST(floor(l_quantity) AS INTEGER) % 6)
            WHEN 5 THEN 'pkg' || l_partkey || ' == ' || (CAST(floor(l_quantity) AS INTEGER) % 6) || '.*'
            ELSE '  -r pkg' || l_partkey || '.txt' END AS line
        FROM lineitem""",
    "order_deps": f"SELECT repo, pos, package, version FROM ({requirement('dep_lines')})",
    "rated": f"""
        SELECT id, package, severity, introduced, fixed, listed,
               coalesce(summary, 'No summary available') AS summary, coalesce(published, '?') AS published
        FROM (SELECT *, {severity_of('score')} AS severity FROM (
          SELECT p_partkey, 'ADV-' || p_partkey AS id, 'pkg' || (p_partkey - p_partkey % 3) AS package,
            CASE WHEN p_size % 2 = 0 THEN '0' ELSE {dotted('p_size')} END AS introduced,
            CASE WHEN p_size % 5 <> 0 THEN {dotted('p_size + 7')} END AS fixed,
            (p_size % 6) || '.0.0' AS listed,
            CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CVSS base score 8.1 found'
              WHEN 3 THEN 'severity: 5.5' ELSE p_name END AS summary,
            CASE WHEN p_partkey % 7 <> 0 THEN '2024-01-01' END AS published,
            CASE WHEN p_partkey % 97 > 2 AND p_partkey % 6 = 2 THEN p_size / 5.0
              WHEN p_partkey % 97 > 2 AND p_partkey % 6 = 4 THEN 9.8
              WHEN p_partkey % 5 = 1 THEN 8.1 WHEN p_partkey % 5 = 3 THEN 5.5 END AS score
          FROM part))""",
    "releases": """
        SELECT 'order' || (l_orderkey % 100) AS repo, l_orderkey * 10 + l_linenumber AS pos, 'pkg' || (l_partkey % 30) AS package,
          (CASE WHEN l_orderkey % 17 = 0 THEN 'v' ELSE '' END) || (CASE WHEN l_orderkey % 11 = 0 THEN '1!' ELSE '' END) ||
          (q % 3) || (CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 3 = 0 THEN '' ELSE '.' || (l_orderkey % 3) END) ||
          (CASE WHEN l_orderkey % 5 = 0 THEN '.0' ELSE '' END) ||
          (CASE WHEN l_partkey % 5 IN (1, 2, 3) THEN sep || [['a', 'ALPHA', 'alpha'], ['b', 'Beta', 'beta'],
             ['rc', 'c', 'preview']][l_partkey % 5][l_partkey % 3 + 1] || sep || (l_partkey // 5 % 12) ELSE '' END) ||
          (CASE WHEN l_orderkey % 7 = 0 THEN (CASE WHEN l_partkey % 2 = 0 THEN '.post' ELSE '-' END) || (l_partkey % 3) ELSE '' END) ||
          (CASE WHEN l_orderkey % 6 = 1 THEN '.dev' || (q % 12) ELSE '' END) ||
          (CASE WHEN l_orderkey % 13 = 5 THEN '+' || l_linenumber ELSE '' END) AS version,
          [CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END, q % 3, l_orderkey % 3,
           CASE WHEN l_partkey % 5 IN (1, 2, 3) THEN l_partkey % 5
             WHEN l_orderkey % 6 = 1 AND l_orderkey % 7 <> 0 THEN 0 ELSE 9 END,
           CASE WHEN l_partkey % 5 IN (1, 2, 3) THEN l_partkey // 5 % 12 ELSE 0 END,
           CASE WHEN l_orderkey % 7 = 0 THEN l_partkey % 3 ELSE -1 END,
           CASE WHEN l_orderkey % 6 = 1 THEN q % 12 ELSE 99 END,
           CASE WHEN l_orderkey % 13 = 5 THEN l_linenumber ELSE -1 END] AS parts
        FROM (SELECT *, CAST(floor(l_quantity) AS INTEGER) AS q, ['', '-', '.'][l_partkey % 3 + 1] AS sep FROM lineitem)""",
    "picked": """
        SELECT repo, arg_min(path, r) AS filename, arg_min(spec_lines, r) AS content FROM (
          SELECT repo, path, spec_lines, CASE path WHEN 'requirements.txt' THEN 1
            WHEN 'pyproject.toml' THEN 2 WHEN 'package.json' THEN 3 END AS r
          FROM root_files) WHERE r IS NOT NULL GROUP BY repo""",
    "repo_deps": f"""
        SELECT repo, package, version FROM ({requirement(
            "(" + lines_of("(SELECT repo, filename AS path, content FROM picked "
                           "WHERE filename <> 'package.json')") + ")")})""",
    "repo_dep_counts": f"""
        SELECT d.repo, d.n, v.vulns, v.criticals FROM
        (SELECT repo, package, version, count(*) AS n FROM repo_deps GROUP BY ALL) d LEFT JOIN
        (SELECT repo, package, version, count(*) AS vulns,
           count(*) FILTER (WHERE severity = 'Critical') AS criticals
         FROM ({matched('(SELECT DISTINCT * FROM repo_deps)')}) GROUP BY ALL) v
        ON d.repo = v.repo AND d.package = v.package AND d.version IS NOT DISTINCT FROM v.version""",
    "cves": """
        SELECT repo, CAST(sum(n) AS BIGINT) AS packages_checked,
          CAST(coalesce(sum(n * vulns), 0) AS BIGINT) AS n_cves,
          CAST(coalesce(sum(n * criticals), 0) AS BIGINT) AS n_critical_cves,
          CAST(coalesce(sum(n) FILTER (WHERE vulns > 0), 0) AS BIGINT) AS n_vulnerable_packages
        FROM repo_dep_counts GROUP BY repo""",
    "secret_files": f"SELECT repo, path, content FROM files WHERE {SECRET_OK}",
    "deep_files": f"SELECT repo, path, content FROM files WHERE {DEEP_OK}",
    "secrets": secret_rows("secret_files"),
    "deep_lines": f"SELECT *, {LANGUAGE} AS language FROM ({lines_of('deep_files')})",
    "dangers": dangerous_rows("deep_lines"),
    "all_blobs": "SELECT repo, path, content FROM files WHERE kind = 'blob'",
    "listed": f"""
        SELECT repo, path, pos FROM (SELECT source AS repo, doc_id,
          {pick(S.DIRECTORIES)} || {STEM} || {pick(S.EXTENSIONS)} AS path, -doc_id AS pos FROM documents)
        WHERE {NUM} % 2 = 0 AND doc_id % 5 = 0""",
    "surface": surface_rows("deep_files"),
    "surface_counts": surface_pivot("surface"),
    "file_smells": smell_rows("deep_files"),
    "all_surface": surface_rows("files"),
    "all_surface_counts": f"""
        SELECT r.repo, {REPO_SURFACES} FROM repo_names r
        LEFT JOIN ({surface_pivot('all_surface')}) p ON p.repo = r.repo""",
    "tests": """
        SELECT repo, bool_or(kind = 'blob' AND lower(path) LIKE '%test%') AS has_tests_folder,
               bool_or(lower(path) LIKE '%test%') AS has_test_entries FROM files GROUP BY repo""",
    "danger_counts": "SELECT repo, count(*) AS n_dangerous, "
    + ", ".join(
        f"count(*) FILTER (WHERE severity = '{s}') AS d_{s.lower()}"
        for s in ("Critical", "High", "Medium", "Low")
    )
    + ", "
    + ", ".join(
        f"count(*) FILTER (WHERE owasp LIKE 'A{n}:%') AS a{n}" for n in ("01", "02", "03", "08")
    )
    + " FROM dangers GROUP BY repo",
    "smell_counts": """
        SELECT repo, count(*) FILTER (WHERE severity = 'High') AS s_high,
          count(*) FILTER (WHERE severity = 'Medium') AS s_medium,
          count(*) FILTER (WHERE title LIKE 'Disabled%') AS s_mis,
          count(*) FILTER (WHERE title LIKE '%God%') AS s_design FROM file_smells GROUP BY repo""",
    "tallies": f"""
        SELECT *, {RATING} AS rating, s_file_high + density + danger AS s_high FROM (
        SELECT *, CAST(a02 >= 3 AS INTEGER) AS density,
               CAST(file_uploads >= 2 AND rest_endpoints >= 5 AS INTEGER) AS danger FROM (
        SELECT r.repo, coalesce(n_secrets, 0) AS n_secrets, coalesce(n_dangerous, 0) AS n_dangerous,
          {', '.join(f'coalesce({c}, 0) AS {c}' for c in
                     ('d_critical', 'd_high', 'd_medium', 'd_low', 'a01', 'a02', 'a03', 'a08',
                      's_medium', 's_mis', 's_design', 'packages_checked', 'n_cves',
                      'n_critical_cves', 'n_vulnerable_packages'))},
          coalesce(s_high, 0) AS s_file_high, {REPO_SURFACES}, has_test_entries AS has_tests
        FROM repo_names r
        LEFT JOIN (SELECT repo, count(*) AS n_secrets FROM secrets GROUP BY repo) s ON s.repo = r.repo
        LEFT JOIN danger_counts d ON d.repo = r.repo
        LEFT JOIN smell_counts m ON m.repo = r.repo
        LEFT JOIN surface_counts u ON u.repo = r.repo
        LEFT JOIN cves c ON c.repo = r.repo
        LEFT JOIN tests t ON t.repo = r.repo))""",
    "factors": """
        SELECT repo, 1 AS rule, n_critical_cves AS n, least(n_critical_cves * 5, 15) AS points, 'Critical CVE(s) in dependencies' AS what FROM tallies
        UNION ALL SELECT repo, 2, n_cves - n_critical_cves, least((n_cves - n_critical_cves) * 2, 6), 'non-critical CVE(s) in dependencies' FROM tallies
        UNION ALL SELECT repo, 3, n_secrets, least(n_secrets * 3, 9), 'potential secrets exposed' FROM tallies
        UNION ALL SELECT repo, 4, d_critical, least(d_critical * 4, 12), 'Critical API pattern(s) detected' FROM tallies
        UNION ALL SELECT repo, 5, d_high, least(d_high * 2, 6), 'High-risk API pattern(s) detected' FROM tallies
        UNION ALL SELECT repo, 6, d_medium, least(d_medium, 3), 'Medium-risk API pattern(s) detected' FROM tallies
        UNION ALL SELECT repo, 7, s_high, least(s_high * 2, 4), 'High-severity security smell(s)' FROM tallies
        UNION ALL SELECT repo, 8, s_medium, least(s_medium, 2), 'Medium-severity security smell(s)' FROM tallies
        UNION ALL SELECT repo, 9, 1, 3, 'Significant attack surface exposure' FROM tallies WHERE rating = 'HIGH'
        UNION ALL SELECT repo, 9, 1, 1, 'Moderate attack surface exposure' FROM tallies WHERE rating = 'MEDIUM'""",
    "factor_texts": """
        SELECT repo, rule, points, CASE WHEN rule < 9 THEN n || ' ' || what || ' (−' || points || ' pts)'
          WHEN points = 3 THEN what || ' (−3 pts)' ELSE what || ' (−1 pt)' END AS factor
        FROM factors WHERE n > 0""",
    "scores": """
        SELECT *, CASE WHEN score >= 25 THEN 'LOW' WHEN score >= 17 THEN 'MEDIUM'
                       WHEN score >= 10 THEN 'HIGH' ELSE 'CRITICAL' END AS risk
        FROM (SELECT t.*, CAST(greatest(0, least(30, 30 - coalesce(f.points, 0))) AS INTEGER) AS score,
                CAST(coalesce(f.k, 0) AS INTEGER) AS n_negative,
                CAST(1 + CAST(has_tests AS INTEGER)
                  + CAST(n_cves = 0 AND n_secrets = 0 AND n_dangerous = 0 AS INTEGER)
                  + CAST(n_cves = 0 AS INTEGER) + CAST(n_secrets = 0 AS INTEGER) AS INTEGER) AS n_positive
              FROM tallies t LEFT JOIN (SELECT repo, sum(points) AS points, count(*) AS k
                                        FROM factor_texts GROUP BY repo) f ON f.repo = t.repo)""",
    "explained": """
        SELECT *, 'Final Score: ' || score || '/30 — Risk level: ' || risk || '. ' ||
          CASE WHEN n_negative > 0 THEN n_positive || ' positive factor(s) and ' || n_negative ||
            ' negative factor(s) identified. Prioritize remediation of Critical severity findings.'
          ELSE 'No significant security findings detected via static analysis. Manual verification remains recommended.'
          END AS explanation FROM scores""",
    "repo_smells": """
        SELECT repo, 'High' AS severity, 'Density of Weak Cryptography' AS title FROM tallies WHERE density = 1
        UNION ALL SELECT repo, 'High', 'Concentrated Attack Surface Danger' FROM tallies WHERE danger = 1""",
    "doc_lines": DOC_LINES,
    "doc_sets": """
        SELECT repo, path, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS set_id
        FROM doc_lines GROUP BY repo, path""",
    "set_names": """
        SELECT repo, set_id, n, min(path) AS file, max(path) AS last_file, count(*) AS copies
        FROM doc_sets GROUP BY repo, set_id, n""",
    "set_lines": """
        SELECT s.repo, s.file, s.n, s.copies, l.s FROM set_names s JOIN doc_lines l
        ON l.repo = s.repo AND l.path = s.file""",
    "duplicates": """
        SELECT a.repo, a.file AS file_a, b.file AS file_b, count(*) AS common_lines,
          round_even(count(*) / least(a.n, b.n) * 100, 1) AS similarity_percent,
          a.copies * b.copies AS n_pairs
        FROM set_lines a JOIN set_lines b ON a.repo = b.repo AND a.s = b.s AND a.file < b.file
        GROUP BY a.repo, a.file, b.file, a.n, b.n, a.copies, b.copies
        HAVING round_even(count(*) / least(a.n, b.n) * 100, 1) > 60
        UNION ALL SELECT repo, file, last_file, n, 100.0, CAST(copies * (copies - 1) / 2 AS BIGINT)
        FROM set_names WHERE copies > 1""",
    "set_links": "SELECT repo, file_a AS a, file_b AS b FROM duplicates UNION SELECT repo, file_b, file_a FROM duplicates",
    "reached": """
        SELECT repo, file, file AS other FROM set_names
        UNION SELECT r.repo, r.file, l.b FROM reached r JOIN set_links l ON l.repo = r.repo AND l.a = r.other""",
    "class_names": "SELECT repo, file, min(other) AS class_id FROM reached GROUP BY repo, file",
    "class_pairs": """
        SELECT d.*, c.class_id FROM duplicates d JOIN class_names c ON c.repo = d.repo AND c.file = d.file_a""",
    "link_counts": """
        SELECT n.repo, n.file, n.copies - 1 + coalesce(sum(o.copies), 0) AS n_links,
          greatest(max(d.similarity_percent), CASE WHEN n.copies > 1 THEN 100.0 END) AS closest_percent
        FROM set_names n LEFT JOIN (SELECT repo, file_a AS x, file_b AS y, similarity_percent FROM duplicates
            WHERE (repo, file_b) IN (SELECT (repo, file) FROM set_names)
          UNION ALL SELECT repo, file_b, file_a, similarity_percent FROM duplicates
            WHERE (repo, file_b) IN (SELECT (repo, file) FROM set_names)) d ON d.repo = n.repo AND d.x = n.file
        LEFT JOIN set_names o ON o.repo = n.repo AND o.file = d.y
        GROUP BY n.repo, n.file, n.copies""",
    "py_lines": (
        "SELECT DISTINCT repo, path, s FROM (SELECT repo, path, "
        f"{strip('line')} AS s FROM ({lines_of('py_files')})) WHERE s <> ''"
    ),
    "selected": """
        SELECT repo, path, rn FROM (
          SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY strlen(content) DESC, path) AS INTEGER) AS rn
          FROM py_files WHERE NOT ends_with(path, '__init__.py') AND NOT lower(path) LIKE '%test%'
            AND NOT contains(lower(regexp_extract(path, '([^/]*)$', 1)), 'config')) WHERE rn <= 4""",
    "selected_lines": """
        SELECT DISTINCT l.repo, l.path, c.rn, l.s FROM py_lines l JOIN selected c
        ON c.repo = l.repo AND c.path = l.path""",
    "py_sets": """
        SELECT repo, path, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS set_id
        FROM py_lines GROUP BY repo, path""",
    "py_set_names": """
        SELECT repo, set_id, n, min(path) AS file, max(path) AS last_file, count(*) AS copies
        FROM py_sets GROUP BY repo, set_id, n""",
    "py_set_lines": """
        SELECT s.repo, s.file, s.n, s.copies, l.s FROM py_set_names s JOIN py_lines l
        ON l.repo = s.repo AND l.path = s.file""",
    "py_shared": """
        SELECT repo, file, s FROM py_set_lines WHERE (repo, s) IN (
          SELECT (repo, s) FROM py_set_lines GROUP BY repo, s HAVING count(*) > 1)""",
    "py_alike": """
        SELECT n.repo, n.file, n.n, coalesce(string_agg(h.s, chr(10) ORDER BY h.s), 'set ' || n.file) AS shared
        FROM py_set_names n LEFT JOIN py_shared h ON h.repo = n.repo AND h.file = n.file GROUP BY n.repo, n.file, n.n""",
    "py_families": "SELECT repo, file, min(file) OVER (PARTITION BY repo, n, shared) AS family FROM py_alike",
    "py_counted": """
        SELECT d.repo, coalesce(least(a.family, b.family), d.file_a) AS file, d.similarity_percent, d.n_pairs
        FROM py_duplicates d JOIN py_families a ON a.repo = d.repo AND a.file = d.file_a
        JOIN py_families b ON b.repo = d.repo AND b.file = d.file_b""",
    "py_duplicates": """
        SELECT a.repo, a.file AS file_a, b.file AS file_b, round_even(count(*) / least(a.n, b.n) * 100, 1) AS similarity_percent,
          a.copies * b.copies AS n_pairs
        FROM py_set_lines a JOIN py_set_lines b ON a.repo = b.repo AND a.s = b.s AND a.file < b.file
        GROUP BY a.repo, a.file, b.file, a.n, b.n, a.copies, b.copies
        HAVING round_even(count(*) / least(a.n, b.n) * 100, 1) > 60
        UNION ALL SELECT repo, file, file, 100.0, CAST(copies * (copies - 1) / 2 AS BIGINT)
        FROM py_set_names WHERE copies > 1""",
    "selected_pairs": """
        SELECT a.repo, a.path AS file_a, b.path AS file_b,
          round_even(coalesce(c.common, 0) / least(a.n, b.n) * 100, 1) AS similarity_percent,
          coalesce(c.common, 0) AS common_lines
        FROM (SELECT repo, path, rn, count(*) AS n FROM selected_lines GROUP BY ALL) a
        JOIN (SELECT repo, path, rn, count(*) AS n FROM selected_lines GROUP BY ALL) b
          ON a.repo = b.repo AND a.rn < b.rn
        LEFT JOIN (SELECT x.repo, x.path AS pa, y.path AS pb, count(*) AS common FROM selected_lines x
          JOIN selected_lines y ON x.repo = y.repo AND x.s = y.s AND x.rn < y.rn GROUP BY ALL) c
          ON c.repo = a.repo AND c.pa = a.path AND c.pb = b.path""",
    "quality": """
        SELECT repo, path AS file, 'cyclomatic_complexity' AS smell_type,
          CASE WHEN complexity > 15 THEN 'CRITICAL' ELSE 'MAJOR' END AS severity,
          CAST(lineno AS BIGINT) AS line, CAST(complexity AS DOUBLE) AS measured_value, CAST(1 AS BIGINT) AS n_occurrences
        FROM blocks WHERE kind <> 'nested' AND complexity > 10
        UNION ALL SELECT repo, path, 'long_function', 'MAJOR', lineno, length, 1 FROM blocks
          WHERE kind <> 'class' AND length > 50
        UNION ALL SELECT repo, path, 'low_documentation', 'MINOR', NULL, documentation_ratio, 1
          FROM doc_ratios WHERE documentation_ratio < 30
        UNION ALL SELECT repo, path, 'todo_accumulation', 'MINOR', NULL, todo + fixme + xxx, 1
          FROM markers WHERE todo + fixme + xxx > 5
        UNION ALL SELECT repo, file, 'duplication',
          CASE WHEN similarity_percent > 80 THEN 'CRITICAL' ELSE 'MAJOR' END AS grade, NULL, max(similarity_percent),
          CAST(sum(n_pairs) AS BIGINT) FROM py_counted GROUP BY repo, file, grade""",
    "texts": f"""
        SELECT source || '/' || doc_id AS repo, CASE WHEN doc_id % 9 = 0 THEN text ELSE
          '# Audit Report: ' || source || {LF} || '## 1. Executive Summary' || {LF} ||
          {report_score('Global Technical Debt', 101, '/100')} || {report_score('Code Quality', 41, '/40')} ||
          {report_score('Security', 31, ' / 30')} ||
          (CASE WHEN doc_id % 4 = 0 THEN {report_score('Repository Structure', 31, '/30')} ELSE '' END) ||
          '### 3. Hotspots Analysis' || {LF} ||
          (CASE WHEN doc_id % 3 = 0 THEN 'CRITICAL HOTSPOT and critical hotspot' || {LF} ELSE '' END) ||
          text || {LF} || '## 5. Security Analysis' || {LF} || 'CVE-2024-' || (doc_id + 1000) ||
          ' cve-2023-1' || {LF} || '## 6. Priority Action Plan' || {LF} || 'P1' || {LF} ||
          (CASE WHEN doc_id % 5 = 0 THEN '### 3. Hotspots Analysis' || {LF} || ' second ' || {LF} ELSE '' END)
          END AS text FROM documents""",
    "report_lines": f"""
        SELECT repo, n, line, regexp_matches(line, '^#{{1,3}}\\s+.+$') AS is_heading FROM (
          SELECT repo, unnest(string_split(text, {LF})) AS line,
                 generate_subscripts(string_split(text, {LF}), 1) AS n FROM texts)""",
    "numbered": """
        SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY repo ORDER BY n) AS k
        FROM report_lines""",
    "raw_sections": f"""
        SELECT repo, k, {strip("regexp_extract(max(line) FILTER (WHERE is_heading), '^#{1,3}[ ]+(.+)$', 1)")} AS section,
          {strip(f"coalesce(string_agg(line, {LF} ORDER BY n) FILTER (WHERE NOT is_heading), '')")} AS content
        FROM numbered WHERE k > 0 GROUP BY repo, k""",
    "sections": """
        SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY first_k) - 1 AS INTEGER) AS section_pos,
          section, content FROM (SELECT repo, section, min(k) AS first_k, arg_max(content, k) AS content
          FROM raw_sections GROUP BY repo, section)
        UNION ALL SELECT repo, 0, 'Full Report', text FROM texts
        WHERE repo NOT IN (SELECT repo FROM report_lines WHERE is_heading)""",
    "agent_rows": """
        SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, text, role = 'assistant' AS is_final,
          CASE role WHEN 'assistant' THEN 'security_agent' WHEN 'user' THEN 'visitor' ELSE 'unknown' END AS author
        FROM conversations""",
    "tool_rows": """
        SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq,
          CASE WHEN event_type <> 'error' THEN event_type END AS tool,
          CASE WHEN event_id % 4 <> 0 THEN 'agent_' || (event_id % 4) ELSE 'unknown' END AS author
        FROM events""",
    "plan": f"""
        SELECT repo, severity, title, 'security' AS source, CAST(sum(n) AS BIGINT) AS n_findings FROM (
          SELECT repo, 'High' AS severity, 'Potential secret: ' || pattern AS title, 1 AS n FROM secrets
          UNION ALL SELECT repo, severity, title, 1 FROM dangers
          UNION ALL SELECT repo, severity, title, 1 FROM file_smells
          UNION ALL SELECT repo, severity, title, 1 FROM repo_smells
          UNION ALL SELECT repo, list_extract(['Critical','High','Medium','Low','Unknown'], min({RANK})),
            'Vulnerable dependency: ' || package, count(DISTINCT id)
            FROM ({matched('repo_deps')}) GROUP BY repo, package) GROUP BY repo, severity, title
        UNION ALL SELECT repo, severity, 'Code quality: ' || smell_type, 'quality',
          CAST(sum(n_occurrences) AS BIGINT) FROM quality GROUP BY repo, severity, smell_type""",
}
MATERIALIZED = {
    "files", "deep_lines", "dangers", "secrets", "surface", "file_smells", "tallies", "factor_texts",
    "doc_lines", "set_lines", "blocks", "py_files", "selected", "selected_lines", "rated",
    "order_deps", "repo_deps", "texts", "report_lines", "raw_sections", "quality", "doc_sets",
    "set_names", "commits", "py_lines", "py_sets", "py_set_names", "py_set_lines", "duplicates", "class_names",
    "py_duplicates", "py_families",
}

OWASP_PREFIX = {c[:3].lower(): (c, label, about) for c, label, about in R.OWASP_CATEGORIES}


def _owasp_rows() -> str:
    rows = []
    for prefix, (category, label, about) in OWASP_PREFIX.items():
        detected = prefix if prefix in ("a01", "a02", "a03", "a08") else "0"
        confirmed = "CAST(n_cves > 0 AS INTEGER)" if prefix == "a06" else "0"
        other = {
            "a02": "CAST(n_secrets > 0 AS INTEGER)", "a04": "(s_design + density)",
            "a05": "s_mis", "a09": "1", "a10": "1",
        }.get(prefix, "0")
        rows.append(
            f"SELECT repo, '{category}' AS category, {text(label)} AS label, {text(about)} AS description, CAST({detected} + {confirmed} + {other} AS BIGINT) AS n_findings, "
            f"CASE WHEN {detected} + {confirmed} + {other} = 0 THEN 'No evidence found.' "
            f"WHEN {confirmed} > 0 THEN {confirmed} || ' confirmed finding(s).' "
            f"WHEN {detected} > 0 THEN {detected} || ' dangerous pattern(s) detected — review recommended.' "
            "ELSE 'Manual review recommended.' END AS status FROM tallies"
        )
    return " UNION ALL ".join(rows)


TAB_HITS = {
    tab: " OR ".join(f"contains(lower(section), '{w}')" for w in words)
    for tab, words in R.REPORT_TABS
}

QUERIES = {
    "repo_structure": """
        SELECT r.repo, r.default_branch, coalesce(count(f.path) FILTER (WHERE f.kind = 'blob'), 0) AS total_files,
          bool_or(f.kind = 'blob' AND lower(f.path) LIKE '%test%') AS has_tests_folder,
          r.stars, r.language
        FROM repos r LEFT JOIN files f ON f.repo = r.repo GROUP BY ALL""",
    "repo_scan": """
        SELECT r.*, t.has_tests_folder, b.total_files, d.filename AS dependency_file,
          a.last_commit_date, a.last_commit_message, coalesce(a.sample_size, 0) AS sample_size
        FROM repos r LEFT JOIN tests t ON t.repo = r.repo
        LEFT JOIN (SELECT repo, count(*) AS total_files FROM files WHERE kind = 'blob' GROUP BY repo) b ON b.repo = r.repo
        LEFT JOIN (SELECT repo, arg_min(path, list_position(['requirements.txt','package.json','pom.xml','pyproject.toml'], path)) AS filename
                   FROM root_files GROUP BY repo) d ON d.repo = r.repo
        LEFT JOIN (SELECT repo, max(author_date) AS last_commit_date,
                   arg_max(message, author_date) AS last_commit_message, count(*) AS sample_size
                   FROM commits GROUP BY repo) a ON a.repo = r.repo""",
    "file_extensions": """
        SELECT repo, path, size_bytes, CASE WHEN contains(path, '.')
          THEN list_extract(string_split(path, '.'), -1) END AS extension FROM files WHERE kind = 'blob'""",
    "file_language": f"SELECT repo, path, {LANGUAGE} AS language FROM files WHERE kind = 'blob'",
    "file_sizes": "SELECT repo, path, length(content) AS size FROM files WHERE kind = 'blob'",
    "has_tests": "SELECT * FROM tests",
    "dependency_file": """
        SELECT repo, arg_min(path, list_position(['requirements.txt','package.json','pom.xml','pyproject.toml'], path)) AS filename
        FROM root_files GROUP BY repo""",
    "dependency_file_security": "SELECT repo, filename FROM picked",
    "commit_activity": """
        SELECT repo, max(author_date) AS last_commit_date, arg_max(message, author_date) AS last_commit_message,
          count(*) AS sample_size FROM commits GROUP BY repo""",
    "file_churn": "SELECT * FROM churn",
    "file_churn_week": """
        SELECT repo, path, least(count(*), 10) AS commit_count, max(author_date) AS last_modified
        FROM commits WHERE author_date BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'
        GROUP BY repo, path""",
    "churn_history": """
        SELECT repo, path, as_of, least(count(*), 10) AS commit_count, max(author_date) AS last_modified
        FROM commits, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS as_of)
        WHERE author_date BETWEEN as_of - INTERVAL 7 DAY AND as_of GROUP BY repo, path, as_of""",
    "churn_windows": """
        SELECT repo, path, as_of, count(*) AS commit_count, max(author_date) AS last_modified
        FROM (SELECT DISTINCT repo, path, sha, author_date FROM commits),
          (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS as_of)
        WHERE author_date >= as_of - INTERVAL 7 DAY AND author_date < as_of GROUP BY repo, path, as_of""",
    "secret_candidates": f"SELECT repo, path FROM files WHERE {SECRET_OK}",
    "deep_candidates": f"SELECT repo, path FROM files WHERE {DEEP_OK}",
    "first_secret_candidates": f"""
        SELECT repo, path, CAST(row_number() OVER w AS INTEGER) AS rn FROM files WHERE {SECRET_OK}
        WINDOW w AS (PARTITION BY repo ORDER BY {DEPTH}, path) QUALIFY row_number() OVER w <= 10""",
    "first_deep_candidates": f"""
        SELECT repo, path, CAST(row_number() OVER w AS INTEGER) AS rn FROM files WHERE {DEEP_OK}
        WINDOW w AS (PARTITION BY repo ORDER BY {DEPTH}, path) QUALIFY row_number() OVER w <= 20""",
    "analyst_selection": "SELECT * FROM selected",
    "secret_scan": "SELECT * FROM secrets",
    "secret_scan_long_files": f"""
        SELECT s.repo, chapter, CAST(before + s.lineno AS BIGINT) AS lineno, pattern, snippet FROM secrets s JOIN (
          SELECT repo, path, chapter, sum(n) OVER (PARTITION BY repo, chapter ORDER BY path) - n AS before FROM (
            SELECT repo, path, len(string_split_regex(content, {BREAK})) AS n,
              coalesce(TRY_CAST(regexp_extract(path, '_([0-9]+)[.]', 1) AS BIGINT) // 10000, -1) AS chapter
            FROM secret_files)) f ON f.repo = s.repo AND f.path = s.path""",
    "secret_counts": """
        SELECT f.repo, f.path, count(s.pattern) AS finding_count FROM secret_files f
        LEFT JOIN secrets s ON s.repo = f.repo AND s.path = f.path GROUP BY f.repo, f.path""",
    "secret_scan_selected": f"""
        SELECT s.* FROM secrets s JOIN (SELECT repo, path FROM files WHERE {SECRET_OK}
          QUALIFY row_number() OVER (PARTITION BY repo ORDER BY {DEPTH}, path) <= 10) c
        ON c.repo = s.repo AND c.path = s.path""",
    "dangerous_scan": "SELECT repo, d.id, path AS file, line, severity, title, risk, remediation, owasp, snippet "
    "FROM dangers d JOIN (VALUES "
    + ", ".join(f"({text(p[0])}, {text(p[5])}, {text(p[6])})" for p in R.DANGEROUS_PATTERNS)
    + ") t(id, risk, remediation) ON t.id = d.id",
    "attack_surface_hits": "SELECT * FROM all_surface",
    "attack_surface": " UNION ALL ".join(
        f"SELECT repo, '{c}' AS category, {c} AS n FROM all_surface_counts" for c in SURFACES
    ),
    "attack_surface_rating": f"""
        SELECT repo, {TOTAL} AS total, {RATING} AS rating, CASE WHEN {TOTAL} = 0
          THEN 'No major attack surface components detected (pure library or local utility).'
          WHEN {IS_HIGH} THEN 'Significant attack surface detected with ' || rest_endpoints ||
            ' REST endpoints, ' || db_access || ' database access points, and ' || file_uploads ||
            ' file uploads. Requires thorough review.'
          WHEN {IS_MEDIUM} THEN 'Moderate attack surface detected with ' || rest_endpoints ||
            ' REST endpoints, ' || db_access || ' database access points, and ' || auth_modules ||
            ' authentication configurations.'
          ELSE 'Limited attack surface with only ' || {TOTAL} || ' sensitive components identified.' END AS explanation
        FROM all_surface_counts""",
    "smells": """
        SELECT repo, severity, title, file FROM file_smells
        UNION ALL SELECT repo, severity, title, NULL FROM repo_smells""",
    "smell_details": f"""
        SELECT repo, severity, title, detail, file FROM file_smells
        UNION ALL SELECT t.repo, 'High', 'Density of Weak Cryptography',
          {filled(R.SMELL_DETAILS["Density of Weak Cryptography"], ["n"])}, NULL
        FROM tallies t JOIN (SELECT repo, count(*) AS n FROM dangers WHERE owasp LIKE 'A02%' GROUP BY repo) d ON d.repo = t.repo
        WHERE density = 1
        UNION ALL SELECT t.repo, 'High', 'Concentrated Attack Surface Danger',
          {filled(R.SMELL_DETAILS["Concentrated Attack Surface Danger"], ["t.file_uploads", "t.rest_endpoints"])}, NULL
        FROM tallies t WHERE danger = 1""",
    "secret_scan_listed": f"""
        SELECT s.repo, s.path, s.lineno, s.pattern, s.snippet FROM ({secret_rows("all_blobs")}) s JOIN (
          SELECT repo, path FROM listed QUALIFY row_number() OVER (PARTITION BY repo ORDER BY pos) <= 5
          UNION ALL SELECT repo, path FROM files WHERE {SECRET_OK} AND repo NOT IN (SELECT repo FROM listed)
          QUALIFY row_number() OVER (PARTITION BY repo ORDER BY {DEPTH}, path) <= 5) c
        ON c.repo = s.repo AND c.path = s.path""",
    "quality_findings_skill": """
        SELECT repo, path AS file, 'cyclomatic_complexity' AS smell_type,
          CASE WHEN complexity > 15 THEN 'MAJEUR' ELSE 'MINEUR' END AS severity,
          CAST(lineno AS BIGINT) AS line, CAST(complexity AS DOUBLE) AS measured_value, CAST(1 AS BIGINT) AS n_occurrences
        FROM blocks WHERE kind <> 'nested' AND complexity > 10
        UNION ALL SELECT repo, path, 'long_function', CASE WHEN length > 100 THEN 'MAJEUR' ELSE 'MINEUR' END, lineno, length, 1
          FROM blocks WHERE kind <> 'class' AND length > 50
        UNION ALL SELECT repo, path, 'low_documentation', 'MINEUR', NULL, documentation_ratio, 1
          FROM doc_ratios WHERE documentation_ratio < 30
        UNION ALL SELECT repo, path, 'todo_accumulation', 'MINEUR', NULL, todo + fixme + xxx, 1
          FROM markers WHERE todo + fixme + xxx > 5
        UNION ALL SELECT repo, file, 'duplication', 'MAJEUR', NULL, max(similarity_percent),
          CAST(sum(n_pairs) AS BIGINT) FROM py_counted WHERE similarity_percent > 80 GROUP BY repo, file
        UNION ALL SELECT repo, NULL, 'no_tests', 'CRITIQUE', NULL, 0.0, 1 FROM py_files
          GROUP BY repo HAVING NOT bool_or(contains(lower(path), 'test'))""",
    "event_log": """
        SELECT CASE WHEN ok THEN 's' || conv_id END AS session, CASE WHEN ok THEN turn END AS seq,
          CASE WHEN ok THEN role END AS author,
          CASE WHEN ok AND role = 'assistant' THEN 'tool_' || (turn % 3) END AS tool,
          CASE WHEN ok THEN coalesce(text || chr(10), '') || 'end' END AS text,
          CASE WHEN ok THEN coalesce(role = 'assistant', false) END AS is_final,
          CASE WHEN ok AND role = 'assistant' THEN 'tool_' || (turn % 3) || ',tool_' || (turn % 3) END AS tools,
          CASE WHEN ok AND conv_id % 5 = 0 THEN '{"usage":"' || (turn * 10) || '"}' END AS rescued,
          CASE WHEN kind = 1 THEN substring(line, 1, 30) WHEN kind = 2 THEN replace(line, '"session":', '"sesion":')
            WHEN kind = 3 THEN replace(line, '"seq":', '"seq":"x"') END AS bad_line,
          CASE kind WHEN 1 THEN 'no JSON object' WHEN 2 THEN 'no session' WHEN 3 THEN 'no JSON object' END AS error
        FROM (SELECT *, kind = 0 AS ok,
            '{"session":"s' || conv_id || '","seq":' || turn || coalesce(',"author":"' || role || '"', '') ||
            coalesce(',"is_final":' || (role = 'assistant'), '') || ',"content":{"parts":[{' ||
            coalesce('"text":' || to_json(text), '') || '},{' ||
            CASE WHEN role = 'assistant' THEN '"function_call":{"name":"tool_' || (turn % 3) || '"}' ELSE '' END ||
            '},{"text":"end"' ||
            CASE WHEN role = 'assistant' THEN ',"function_call":{"name":"tool_' || (turn % 3) || '"}' ELSE '' END || '}]}' ||
            CASE WHEN conv_id % 5 = 0 THEN ',"usage":' || (turn * 10) ELSE '' END || '}' AS line
          FROM (SELECT *, CASE WHEN turn = 1 AND conv_id % 7 IN (1, 2, 3) THEN conv_id % 7 ELSE 0 END AS kind FROM conversations))""",
    "owasp_coverage": _owasp_rows(),
    "owasp_findings": """
        SELECT repo, owasp AS category, 'Detected' AS type,
          '[' || id || '] ' || title || ' — ' || path || ':' || line AS source FROM dangers
        UNION ALL SELECT repo, CASE WHEN title LIKE 'Disabled%' THEN 'A05:Security Misconfiguration' ELSE 'A04:Insecure Design' END,
          CASE WHEN title LIKE 'Disabled%' THEN 'Suspicious' ELSE 'Manual Review Recommended' END,
          'Security Smell: ' || title
          FROM (SELECT repo, title FROM file_smells UNION ALL SELECT repo, title FROM repo_smells)
          WHERE title LIKE 'Disabled%' OR title LIKE '%God%' OR title LIKE 'Density%'
        UNION ALL SELECT repo, 'A06:Vulnerable Components', 'Confirmed', n_cves || ' CVE(s) detected in dependencies via OSV.dev.'
          FROM tallies WHERE n_cves > 0
        UNION ALL SELECT repo, 'A02:Cryptographic Failures', 'Suspicious', n_secrets || ' potential secrets exposed in source files.'
          FROM tallies WHERE n_secrets > 0
        UNION ALL SELECT repo, 'A09:Logging Failures', 'Manual Review Recommended',
          'Security logging coverage cannot be fully validated via static pattern matching.' FROM tallies
        UNION ALL SELECT repo, 'A10:SSRF', 'Manual Review Recommended',
          'Verify that outgoing HTTP requests do not process arbitrary, unvalidated user URLs.' FROM tallies""",
    "security_score": "SELECT repo, score, risk, n_positive, n_negative, explanation FROM explained",
    "security_score_compat": """
        SELECT repo, CAST(greatest(0, least(30, 30 - p)) AS INTEGER) AS score FROM (
          SELECT t.repo, least(n_cves * 2, 6) + coalesce((SELECT sum(points) FROM factor_texts f
            WHERE f.repo = t.repo AND f.rule > 2), 0) AS p FROM tallies t)""",
    "top_negative_factors": """
        SELECT repo, CAST(rank AS INTEGER) AS rank, factor, CAST(points AS INTEGER) AS points FROM (
          SELECT *, row_number() OVER (PARTITION BY repo ORDER BY points DESC, rule) AS rank FROM factor_texts)
        WHERE rank <= 3""",
    "findings_by_severity": """
        SELECT * FROM (
          SELECT repo, 'Critical' AS severity, d_critical AS n, 1 AS rank FROM tallies
          UNION ALL SELECT repo, 'High', d_high + s_high, 2 FROM tallies
          UNION ALL SELECT repo, 'Medium', d_medium + s_medium, 3 FROM tallies
          UNION ALL SELECT repo, 'Low', d_low, 4 FROM tallies) WHERE n > 0""",
    "dependencies": "SELECT * FROM order_deps",
    "first_dependencies": """
        SELECT repo, package, version FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rowid_) AS n
          FROM (SELECT repo, package, version, lineno AS rowid_ FROM ("""
    + requirement(
        "(" + lines_of("(SELECT repo, filename AS path, content FROM picked WHERE filename <> 'package.json')") + ")"
    )
    + "))) WHERE n <= 20",
    "advisory_severity": "SELECT id, severity FROM rated",
    "dependency_vulnerabilities": f"""
        SELECT repo, pos, package, version, id, severity, summary, published, 'CVE-2024-' || substr(id, 5) AS aliases
        FROM ({matched('order_deps')})
        UNION ALL SELECT repo, pos, package, version, NULL, NULL, NULL, NULL, NULL FROM order_deps d
        WHERE (package, coalesce(version, '')) NOT IN
          (SELECT (package, coalesce(version, '')) FROM ({matched('(SELECT DISTINCT package, version FROM order_deps)')}))""",
    "dependency_vulnerabilities_spelling": f"""
        SELECT repo, pos, CASE pos % 10 % 3 WHEN 0 THEN 'PKG-' WHEN 1 THEN 'Pkg__' ELSE 'pkg.-_' END
          || substr(package, 4) AS package, version, id, severity FROM ({matched('order_deps')})""",
    "version_order": """
        SELECT package, version, CAST(dense_rank() OVER (PARTITION BY package ORDER BY parts) AS INTEGER) AS place
        FROM (SELECT DISTINCT package, version, parts FROM releases)""",
    "dependency_vulnerabilities_releases": """
        SELECT r.repo, r.pos, r.package, r.version, 'ADV-' || p_partkey AS id FROM releases r
        JOIN part ON p_partkey % 20 = 0 AND r.package = 'pkg' || (p_partkey % 30)
        WHERE r.parts >= (CASE WHEN p_size % 4 = 0 THEN [0, 1, 0, 1, 1, -1, 99, -1] ELSE [0, 0, 0, 9, 0, -1, 99, -1] END)
          AND r.parts < (CASE WHEN p_partkey % 2 = 0 THEN [0, p_size % 3, p_partkey % 3, 3, p_size % 12, -1, 99, -1]
            ELSE [0, p_size % 3, p_partkey % 3, 0, 0, -1, p_size % 12, -1] END)""",
    "vulnerable_packages": f"""
        SELECT d.repo, d.pos, d.package, m.vuln_count FROM order_deps d JOIN
          (SELECT package, version, count(*) AS vuln_count
           FROM ({matched('(SELECT DISTINCT package, version FROM order_deps)')}) GROUP BY ALL) m
        ON d.package = m.package AND d.version IS NOT DISTINCT FROM m.version""",
    "dependency_counts": f"""
        SELECT d.repo, d.pos, d.package, d.version, coalesce(m.vuln_count, 0) AS vuln_count,
          coalesce(m.critical_count, 0) AS critical_count FROM order_deps d LEFT JOIN
          (SELECT package, version, count(*) AS vuln_count, count(*) FILTER (WHERE severity = 'Critical') AS critical_count
           FROM ({matched('(SELECT DISTINCT package, version FROM order_deps)')}) GROUP BY ALL) m
        ON d.package = m.package AND d.version IS NOT DISTINCT FROM m.version""",
    "package_vulnerability_rollup": f"""
        SELECT repo, package, count(*) AS n_cve,
          list_extract(['Critical','High','Medium','Low','Unknown'], min(r)) AS max_severity,
          CAST(min(r) AS INTEGER) AS severity_rank
        FROM (SELECT DISTINCT repo, package, id, {RANK} AS r FROM ({matched('order_deps')}))
        GROUP BY repo, package""",
    "package_advisory_ids": f"SELECT DISTINCT repo, package, id FROM ({matched('order_deps')})",
    "security_totals": """
        SELECT repo, n_cves AS total_vulnerabilities, n_secrets AS total_secrets, n_vulnerable_packages FROM tallies""",
    "repo_security_basic": f"""
        SELECT t.repo, coalesce(p.filename, 'none') AS dependency_file_scanned, packages_checked,
          coalesce(f.k, 0) AS files_scanned, n_cves AS total_vulnerabilities, n_secrets AS total_secret_findings,
          n_vulnerable_packages, 'Security analysis for ' || t.repo || ': ' || n_cves ||
          ' OSV vulnerability(ies) found in ' || n_vulnerable_packages || ' package(s), ' || n_secrets ||
          ' potential secret(s) detected in ' || coalesce(f.k, 0) || ' file(s).' AS summary
        FROM tallies t LEFT JOIN picked p ON p.repo = t.repo
        LEFT JOIN (SELECT repo, count(*) AS k FROM secret_files GROUP BY repo) f ON f.repo = t.repo""",
    "repo_security_report": """
        SELECT t.repo, coalesce(p.filename, 'none') AS dependency_file_scanned, packages_checked,
          n_cves AS total_vulnerabilities, n_critical_cves AS critical_vulnerabilities,
          n_secrets AS total_secret_findings, n_vulnerable_packages, coalesce(f.k, 0) AS files_analyzed,
          n_dangerous, d_critical AS dangerous_critical, """
    + TOTAL
    + """ AS surface_total, rating AS surface_rating, s_high + s_medium AS n_smells, has_tests, score, risk,
          explanation, 'Deep security analysis of ' || t.repo || ': ' || n_cves || ' CVE(s), ' || n_secrets ||
          ' secret(s), ' || n_dangerous || ' dangerous API(s), ' || (s_high + s_medium) ||
          ' security smell(s). Security score: ' || score || '/30 — Risk level: ' || risk || '.' AS summary
        FROM explained t LEFT JOIN picked p ON p.repo = t.repo
        LEFT JOIN (SELECT repo, count(*) AS k FROM deep_files GROUP BY repo) f ON f.repo = t.repo""",
    "todo_counts": "SELECT repo, path, todo, fixme, xxx, todo + fixme + xxx AS total FROM markers",
    "functions": "SELECT * FROM blocks",
    "long_functions": "SELECT repo, path, name, length AS lines, lineno FROM blocks WHERE kind <> 'class' AND length > 50",
    "complex_functions": "SELECT repo, path, name, complexity, lineno FROM blocks WHERE kind <> 'nested' AND complexity > 10",
    "documentation_ratio": "SELECT * FROM doc_ratios",
    "max_complexity": "SELECT * FROM max_complexities",
    "hotspots": """
        SELECT *, CASE WHEN hotspot_score > 100 THEN 'CRITICAL HOTSPOT' WHEN hotspot_score > 40
          THEN 'MODERATE HOTSPOT' ELSE 'STABLE' END AS risk_level,
          '''' || path || ''' has a hotspot score of ' || hotspot_score || ' (complexity=' || max_complexity ||
          ' × ' || commit_count || ' commits in 90 days). Risk level: ' || risk_level || '.' AS interpretation
        FROM hot""",
    "file_quality": f"""
        SELECT f.repo, f.path, length(f.content) AS size,
          CASE WHEN NOT d.has_error THEN (SELECT count(*) FROM golden g WHERE g.snippet = f.snippet AND kind <> 'class' AND length > 50) END AS n_long_functions,
          CASE WHEN NOT d.has_error THEN (SELECT count(*) FROM golden g WHERE g.snippet = f.snippet AND kind <> 'nested' AND complexity > 10) END AS n_complex_functions,
          m.todo + m.fixme + m.xxx AS todo_total, d.documentation_ratio, d.has_error
        FROM py_files f JOIN doc_ratios d ON d.repo = f.repo AND d.path = f.path
        JOIN markers m ON m.repo = f.repo AND m.path = f.path""",
    "file_hotspot_analysis": "",
    "quality_findings": """
        SELECT * FROM quality WHERE smell_type <> 'duplication'
        UNION ALL SELECT repo, file_a, 'duplication',
          CASE WHEN similarity_percent > 80 THEN 'CRITICAL' ELSE 'MAJOR' END, NULL, similarity_percent, n_pairs
          FROM py_duplicates""",
    "debt_score": """
        SELECT repo, n_critical, n_major, n_minor, CAST(greatest(0, 100 - 15 * n_critical - 8 * n_major - 3 * n_minor) AS BIGINT) AS score
        FROM (SELECT r.repo, coalesce(CAST(sum(n_occurrences) FILTER (WHERE severity = 'CRITICAL') AS BIGINT), 0) AS n_critical,
          coalesce(CAST(sum(n_occurrences) FILTER (WHERE severity = 'MAJOR') AS BIGINT), 0) AS n_major,
          coalesce(CAST(sum(n_occurrences) FILTER (WHERE severity = 'MINOR') AS BIGINT), 0) AS n_minor
          FROM repo_names r LEFT JOIN quality q ON q.repo = r.repo GROUP BY r.repo)""",
    "duplication_pairs": "SELECT * FROM duplicates",
    "duplication_classes": """
        SELECT p.repo, p.class_id, m.n_files, CAST(sum(n_pairs) AS BIGINT) AS n_links,
          arg_min(file_a, o) AS file_a, arg_min(file_b, o) AS file_b, arg_min(common_lines, o) AS common_lines,
          max(similarity_percent) AS similarity_percent
        FROM (SELECT *, (-similarity_percent, file_a, file_b) AS o FROM class_pairs) p
        JOIN (SELECT c.repo, c.class_id, CAST(sum(n.copies) AS BIGINT) AS n_files FROM class_names c
              JOIN set_names n ON n.repo = c.repo AND n.file = c.file GROUP BY c.repo, c.class_id) m
          ON m.repo = p.repo AND m.class_id = p.class_id
        GROUP BY p.repo, p.class_id, m.n_files""",
    "duplication_class_members": """
        SELECT d.repo, c.class_id, d.path, d.n AS n_lines, CAST(k.n_links AS BIGINT) AS n_links,
          CAST(k.closest_percent AS DOUBLE) AS closest_percent
        FROM doc_sets d JOIN set_names n ON n.repo = d.repo AND n.set_id = d.set_id AND n.n = d.n
        JOIN class_names c ON c.repo = n.repo AND c.file = n.file
        JOIN link_counts k ON k.repo = n.repo AND k.file = n.file WHERE k.n_links > 0""",
    "duplication_members": """
        SELECT d.repo, n.file AS set_file, d.path, d.n AS n_lines FROM doc_sets d JOIN set_names n
        ON n.repo = d.repo AND n.set_id = d.set_id AND n.n = d.n""",
    "selected_duplication": "SELECT * FROM selected_pairs",
    "action_plan": """
        SELECT repo, CAST(priority AS INTEGER) AS priority, source, severity, title, n_findings,
          CAST(priority * 100 + (CASE source WHEN 'quality' THEN 10 ELSE 0 END) + """
    + RANK
    + """ AS INTEGER) AS order_rank FROM (SELECT *, CASE source WHEN 'security'
          THEN (CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END)
          ELSE (CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'MAJOR' THEN 2 ELSE 3 END) END AS priority FROM plan)""",
    "report_metrics": "SELECT *, "
    + band('"global"') + " AS global_band, "
    + ", ".join(
        f"{band(percent(n, of))} AS {n}_band" for n, of in (("quality", 40), ("security", 30), ("structure", 30))
    )
    + ", CASE WHEN n_cve > 0 THEN 'critical' ELSE 'good' END AS cve_band FROM (SELECT repo, "
    + ", ".join(f'{score_in(p)} AS "{n}"' for n, p, _ in R.REPORT_SCORES)
    + r""", len(regexp_extract_all(text, '(?i)\bCVE-\d{4}-\d+\b')) AS n_cve,
        len(regexp_extract_all(text, '(?i)CRITICAL HOTSPOT')) AS n_critical_hotspot FROM texts)""",
    "report_sections": "SELECT * FROM sections",
    "report_tabs": " UNION ALL ".join(
        f"SELECT t.repo, '{tab}' AS tab, coalesce(arg_min(s.content, s.section_pos) FILTER (WHERE {cond}), '') AS content "
        "FROM texts t LEFT JOIN sections s ON s.repo = t.repo GROUP BY t.repo"
        for tab, cond in TAB_HITS.items()
    ),
    "report_consistency": """
        SELECT repo, 'score_vs_findings' AS check, CASE WHEN d_critical + n_critical_cves > 0 AND score >= 25 THEN 'inconsistent'
          WHEN d_critical + n_critical_cves > 0 AND score >= 20 THEN 'reservation' ELSE 'ok' END AS status FROM scores
        UNION ALL SELECT repo, 'priority_order', 'ok' FROM scores
        UNION ALL SELECT r.repo, 'hotspot_section', CASE WHEN h.repo IS NOT NULL THEN 'ok' ELSE 'reservation' END
          FROM repo_names r LEFT JOIN (SELECT DISTINCT repo FROM py_files) h ON h.repo = r.repo""",
    "agent_timeline": """
        SELECT session, author, min(seq) AS first_seq, count(*) AS event_count,
          arg_min(substring(text, 1, 300), seq) FILTER (WHERE length(text) > 20) AS text_preview,
          CASE author WHEN 'security_agent' THEN 'Security Agent' ELSE author END AS label
        FROM agent_rows GROUP BY session, author""",
    "agent_tools": """
        SELECT session, author, coalesce(string_agg(tool, ',' ORDER BY first_seq) FILTER (WHERE tool IS NOT NULL), '') AS tools,
          CAST(sum(n) AS BIGINT) AS event_count
        FROM (SELECT session, author, tool, min(seq) AS first_seq, count(*) AS n FROM tool_rows GROUP BY ALL)
        GROUP BY session, author""",
    "session_transcript": f"""
        SELECT session, seq, text FROM agent_rows WHERE is_final AND text <> ''""",
}


QUERIES["updated_report"] = QUERIES["repo_security_report"]
QUERIES["report_text"] = f"""
    WITH_LINES SELECT repo, place, text FROM (
      SELECT repo, CAST(0 AS BIGINT) AS place, '# Security report: ' || repo AS text FROM explained
      UNION ALL SELECT repo, 1000, '## Summary' FROM explained
      UNION ALL SELECT repo, 1001, summary FROM ({QUERIES['repo_security_report']})
      UNION ALL SELECT repo, 2000, '## Security Score' FROM explained
      UNION ALL SELECT repo, 2001, '**' || score || '/30** — risk level **' || risk || '**' FROM explained
      UNION ALL SELECT repo, 2002, explanation FROM explained
      UNION ALL SELECT DISTINCT repo, 3000, '## Heaviest Factors' FROM ({QUERIES['top_negative_factors']})
      UNION ALL SELECT repo, 3000 + rank, rank || '. ' || factor FROM ({QUERIES['top_negative_factors']})
      UNION ALL SELECT repo, 4000, '## OWASP Top 10' FROM explained
      UNION ALL SELECT repo, 4000 + CAST(regexp_extract(category, '([0-9]+)', 1) AS BIGINT), '- ' || category || ': ' || status
      FROM ({QUERIES['owasp_coverage']}))""".replace("WITH_LINES ", "")

QUERIES["file_hotspot_analysis"] = (
    f"SELECT q.*, h.* EXCLUDE (repo, path) FROM ({QUERIES['file_quality']}) q "
    f"JOIN ({QUERIES['hotspots']}) h ON h.repo = q.repo AND h.path = q.path"
)


def _names(body: str) -> set[str]:
    """CTE names in a query text, string literals aside."""
    return set(re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", body))) & CTES.keys()


def _needed(query: str) -> list[str]:
    """CTE names a query mentions, directly or not, in order of definition."""
    found: set[str] = set()
    pending = [query]
    while pending:
        body = pending.pop()
        for name in _names(body) - found:
            found.add(name)
            pending.append(CTES[name])
    order: list[str] = []

    def place(name):
        if name in order:
            return
        for other in _names(CTES[name]) & found - {name}:
            place(other)
        order.append(name)

    for name in CTES:
        if name in found:
            place(name)
    return order


def sql(name: str) -> str:
    body = QUERIES[name]
    parts = []
    for cte in _needed(body):
        kind = " MATERIALIZED" if cte in MATERIALIZED else ""
        parts.append(f"{cte} AS{kind} ({CTES[cte].strip()})")
    recursive = "RECURSIVE " if any(part.startswith("reached ") for part in parts) else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body.strip()
