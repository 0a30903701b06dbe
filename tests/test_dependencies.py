import pytest
from pyspark.sql import functions as F

from forgelens.functions import severity as S
from forgelens.functions import versions as V
from forgelens.operators import dependencies as D
from forgelens.sources.advisories import parse_advisories

REQUIREMENTS = {
    "requests==2.28.0": ("requests", "2.28.0"),
    "flask>=3.0.0": ("flask", None),
    "numpy": ("numpy", None),
    "# comment": None,
    "-r other.txt": None,
    "": None,
    "   ": None,
    "requests[security]>=2.28": ("requests", None),
    "a[x,y]==1.2": ("a", "1.2"),
    "c===1.0": ("c", None),
    "e==1.0rc1": ("e", "1.0"),
    "f == 1.*": ("f", "1.*"),
    "g~=2.1": ("g", "2.1"),
    "h!=2": ("h", None),
    "i ; python_version<'3'": ("i", None),
    "[project]": None,
    "=bad": None,
    'name = "x"': ("name", None),
    'version = "1.0"': ("version", None),
    "  padded==1\t": ("padded", "1"),
}


def test_requirement_lines(spark):
    rows = [("r", "requirements.txt", i, line) for i, line in enumerate(REQUIREMENTS)]
    frame = spark.createDataFrame(rows, "repo string, dep_file string, pos int, line string")
    found = {r.pos: (r.package, r.version) for r in D.parse_dependency_lines(frame).collect()}
    for position, (line, expected) in enumerate(REQUIREMENTS.items()):
        assert found.get(position) == expected, line


def test_picked_file_and_cap(make_files):
    lines = "\n".join(f'"p{i}==1.{i}",' for i in range(30))
    files = make_files(
        [
            ("a", "requirements.txt", "x==1\ny"), ("a", "pyproject.toml", "z==1"),
            ("b", "package.json", "{}"), ("b", "sub/requirements.txt", "q==1"),
            ("c", "pyproject.toml", f"[project]\ndependencies = [\n{lines}\n]"),
        ]
    )
    found = D.repo_dependencies(files).collect()
    assert sorted((r.repo, r.package) for r in found if r.repo != "c") == [("a", "x"), ("a", "y")]
    capped = [r.package for r in D.repo_dependencies(files, 20).where("repo='c'").collect()]
    assert sorted(capped) == sorted(f"p{i}" for i in range(20))


@pytest.mark.parametrize(
    "version, expected",
    [("1.0", True), ("1.10.0", True), ("2.0", False), ("0.9", False), (None, True), ("1.*", True),
     ("3.1.0", True), ("1", True), ("1.0.0.0", True)],
)
def test_version_ranges(spark, version, expected):
    spans = F.array(F.struct(F.lit("1.0").alias("introduced"), F.lit("1.11").alias("fixed")))
    given = F.lit(version).cast("string")
    test = V.affects(V.span_keys(spans), F.array(F.lit("3.1.0")), given)
    assert spark.range(1).select(test).first()[0] is expected


# Versions in the order that PEP 440 gives them, spellings of one version side by side
ORDERED = [
    ["0.dev1"], ["0", "0.0", "v0.0.0"], ["0.9.9"], ["1.dev0", "1.0.DEV"], ["1.0.dev456"], ["1.0a0.dev1"], ["1.0a1", "1-alpha1", "1.0.Alpha_1"],
    ["1.0a2.dev456"], ["1.0a2"], ["1.0a12.dev456"], ["1.0a12"], ["1.0b1.dev456"], ["1.0b2", "1.0beta2"],
    ["1.0b2.post345.dev456"], ["1.0b2.post345"], ["1.0rc1.dev456"], ["1.0rc1", "1.0c1", "1.0-pre.1", "1.0preview1"],
    ["1.0rc2"], ["1.0rc11"], ["1", "1.0", " 1.0.0 ", "01.0"], ["1.0+abc.5"], ["1.0+abc.7"], ["1.0+abd"], ["1.0+5"], ["1.0+5.a"], ["1.0+11"],
    ["1.0.post0.dev1"], ["1.0.post0", "1.0.post", "1.0-0"], ["1.0.post456.dev34"], ["1.0.post456", "1.0-456", "1.0.rev456", "1.0-r456"],
    ["1.0.15"], ["1.1.dev1"], ["1.1"], ["1.2", "1.2.0-SNAPSHOT+x y"], ["1.2.0.0.0.1"], ["1.10"], ["2.0rc1"], ["2.0"], ["10"],
    ["100000000000000000000"], ["1!0.1"], ["1!1.0rc1"], ["1!1.0"], ["12!0"],
]


def test_keys_sort_as_versions(spark):
    rows = [(i, v) for i, group in enumerate(ORDERED) for v in group]
    frame = spark.createDataFrame(rows, "i int, v string").withColumn("k", V.version_key(F.col("v")))
    keys = [(bytes(r.k), r.i, r.v) for r in frame.collect()]
    for a, i, v in keys:
        for b, j, w in keys:
            assert (a < b) == (i < j), (v, w)
    assert [(r.i) for r in frame.orderBy("k", "i").collect()] == sorted(i for i, _ in rows)
    odd = spark.createDataFrame([("latest",), ("",), (None,)], "v string").select(V.version_key(F.col("v")).alias("k"))
    none, empty, null = (r.k for r in odd.collect())
    assert none == empty == next(bytes(r.k) for r in frame.where("v = '0'").collect()) and null is None


@pytest.mark.parametrize(
    "version, expected",
    [("2.0rc1", True), ("2.0rc2", False), ("2.0.dev9", True), ("2.0", False), ("1.0a1", False), ("1.0", True),
     ("1.0.post1", True), ("1!0.5", False)],
)
def test_pre_releases_in_ranges(spark, version, expected):
    spans = F.array(F.struct(F.lit("1.0").alias("introduced"), F.lit("2.0rc2").alias("fixed")))
    test = V.affects(V.span_keys(spans), F.array().cast("array<string>"), F.lit(version))
    assert spark.range(1).select(test).first()[0] is expected


def test_whole_versions_of_requirements(spark):
    lines = ["e==1.0rc1", "f == 1!2.0.post1+local.2 ; python_version<'3'", "g~=2.1.dev3", "h>=1.0rc1", "i==1.*", "j===1.0", "k[x]==1.0-alpha.1  # n"]
    frame = spark.createDataFrame(
        [("r", "requirements.txt", i, line) for i, line in enumerate(lines)], "repo string, dep_file string, pos int, line string"
    )
    found = {r.package: r.version for r in D.parse_dependency_lines(frame, full_versions=True).collect()}
    assert found == {"e": "1.0rc1", "f": "1!2.0.post1+local.2", "g": "2.1.dev3", "h": None, "i": "1.*", "j": None, "k": "1.0-alpha.1"}
    places = {(r.package, r.version): r.place for r in D.version_order(D.parse_dependency_lines(frame, full_versions=True)).collect()}
    assert places == {(p, v): 1 for p, v in found.items() if v and "*" not in v}


SEVERITIES = [
    ('{"database_specific":{"cvss_score":9.8}}', None, "Critical"),
    ('{"x":[{"cvss3_score":"8.5"}]}', None, "High"),
    ("{}", "a CVSS score of 5.5 applies", "Medium"),
    ("{}", "Base Score: 2.3", "Low"),
    ('{"database_specific":{"severity":"HIGH"}}', None, "High"),
    ('{"database_specific":{"severity":"Moderate"}}', None, "Medium"),
    ('{"severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"}],"priority":"faible"}', None, "Low"),
    ('{"severity":"élevée"}', None, "High"),
    ('{"level":"weird","a":{"severity":"HIGH"}}', None, "Unknown"),
    ('{"score":"x","cvss":{"score":10}}', None, "Critical"),
    ('{"cvssVersion":"3.1"}', None, "Low"),
    ("not json", "score 7.0", "High"),
    ("{}", "score 17.5", "Unknown"),
    (None, None, "Unknown"),
    ('{"description":"severity 9.9"}', None, "Critical"),
    ('{"score":"nan"}', None, "Low"),
]


def test_severities(spark):
    rows = [
        (str(i), "PyPI", "p", [], [], text, None, None, None, raw)
        for i, (raw, text, _) in enumerate(SEVERITIES)
    ]
    from forgelens.schemas import ADVISORIES

    found = {
        int(r.id): r.severity
        for r in D.advisory_severity(spark.createDataFrame(rows, ADVISORIES)).collect()
    }
    for i, (raw, text, expected) in enumerate(SEVERITIES):
        assert found[i] == expected, (raw, text)


def test_search_order_of_scores():
    document = '{"b":{"score":1.0},"cvss_score":2.0,"score":3.0}'
    assert S.json_score_and_label(document)[0] == 3.0
    assert S.json_score_and_label('{"b":{"score":1.0},"cvss_x":2.0}')[0] == 1.0
    assert S.json_score_and_label('[{"score":null},{"score":true}]')[0] == 1.0


def _advisories(spark, n_hot=0):
    rows = [
        ("A1", "PyPI", "x", [("0", "2.0")], [], None, None, None, None, '{"score":9.5}'),
        ("A2", "PyPI", "x", [("1.5", None)], [], "s", None, "2024", ["C"], '{"score":5}'),
        ("A3", "npm", "x", [("0", None)], [], "s", None, "2024", [], "{}"),
    ]
    rows += [
        (f"H{i:05d}", "PyPI", "hot", [("0", None)], [], "s", None, "2024", [], "{}")
        for i in range(n_hot)
    ]
    from forgelens.schemas import ADVISORIES

    return D.rated_advisories(spark.createDataFrame(rows, ADVISORIES))


def _dependencies(spark, rows):
    return spark.createDataFrame(
        [(r, "requirements.txt", i, p, v, "PyPI") for i, (r, p, v) in enumerate(rows)],
        "repo string, dep_file string, pos int, package string, version string, ecosystem string",
    )


def test_join_with_advisories(spark):
    deps = _dependencies(
        spark, [("r", "x", "1.0"), ("r", "x", "1.9"), ("r", "x", None), ("s", "x", "2.0"),
                ("s", "clean", None), ("s", "x", "2.0")],
    )
    rated = _advisories(spark)
    rows = D.dependency_vulnerabilities(deps, rated).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.pos, set()).add(r.id)
    assert ids == {0: {"A1"}, 1: {"A1", "A2"}, 2: {"A1", "A2"}, 3: {"A2"}, 4: {None}, 5: {"A2"}}
    one = next(r for r in rows if r.id == "A1")
    assert (one.summary, one.published, one.aliases) == ("No summary available", "?", [])
    counts = {r.pos: (r.vuln_count, r.critical_count)
              for r in D.dependency_counts(deps, rated).collect()}
    assert counts == {0: (1, 1), 1: (2, 1), 2: (2, 1), 3: (1, 0), 4: (0, 0), 5: (1, 0)}
    totals = {r.repo: r for r in D.vulnerability_totals(D.dependency_counts(deps, rated)).collect()}
    assert (totals["s"].n_cves, totals["s"].n_vulnerable_packages) == (2, 2)
    assert (totals["r"].n_cves, totals["r"].n_critical_cves) == (5, 3)
    label = D.vulnerability_totals(D.dependency_counts(deps, rated, "Critique"))
    assert {r.n_critical_cves for r in label.collect()} == {0}


def test_rollup_has_one_row_per_package(spark):
    deps = _dependencies(spark, [("r", "hot", None), ("r", "hot", "1"), ("r", "x", None)])
    rated = _advisories(spark, 1700)
    rows = {r.package: r for r in D.package_vulnerability_rollup(deps, rated).collect()}
    assert set(rows) == {"hot", "x"} and rows["hot"].n_cve == 1700
    assert (rows["x"].n_cve, rows["x"].max_severity) == (2, "Critical")
    ids = D.package_advisory_ids(deps, rated).collect()
    assert sorted(r.id for r in ids if r.package == "hot") == [f"H{i:05d}" for i in range(1700)]
    assert sorted(r.id for r in ids if r.package == "x") == ["A1", "A2"]


def test_packages_are_found_in_any_spelling(spark):
    deps = _dependencies(spark, [("r", n, None) for n in ("PyYAML", "typing_extensions", "a..b-_c", "z")])
    rows = [("1", "PyPI", "pyyaml"), ("2", "PyPI", "typing-extensions"), ("3", "PyPI", "A.B.C"), ("4", "npm", "Z")]
    rated = D.rated_advisories(
        spark.createDataFrame(
            [(i, e, p, [("0", None)], [], None, None, None, None, None) for i, e, p in rows],
            "id string, ecosystem string, package string, affected array<struct<introduced:string,fixed:string>>, "
            "versions array<string>, summary string, details string, published string, aliases array<string>, raw_json string",
        )
    )
    found = D.dependency_vulnerabilities(deps, rated).collect()
    assert {(r.package, r.id) for r in found} == {
        ("PyYAML", "1"), ("typing_extensions", "2"), ("a..b-_c", "3"), ("z", None),
    }
    counts = {r.package: r.vuln_count for r in D.dependency_counts(deps, rated).collect()}
    assert counts == {"PyYAML": 1, "typing_extensions": 1, "a..b-_c": 1, "z": 0}


PROJECT = """[build-system]
requires = ["setuptools>=61", 'wheel']  # tools
[project]
name = "demo"
keywords = ["not", "deps"]
dependencies = [
  "requests[security]==2.28.0",  # with ] and "quotes"
  # "commented==1.0",
  'flask ~= 3.0', "numpy",
]
[project.optional-dependencies]
test = ["pytest==7.0"]
docs = [
]
[dependency-groups]
dev = ["ruff==0.4"]
[tool.thing]
dependencies = ["inner==1.0"]
select = ["E", "F"]
"""


def test_project_files_list_their_quoted_specs(spark, make_files):
    files = make_files([("pyproject.toml", PROJECT)])
    found = {(r.package, r.version) for r in D.repo_dependencies(files).collect()}
    assert found == {
        ("setuptools", None), ("wheel", None), ("requests", "2.28.0"), ("flask", "3.0"), ("numpy", None),
        ("pytest", "7.0"), ("ruff", "0.4"), ("inner", "1.0"),
    }
    by_line = {r.package for r in D.repo_dependencies(files, compat=True).collect()}
    assert "name" in by_line and "requests" not in by_line
    assert D.repo_dependencies(make_files([("pyproject.toml", None)])).count() == 0


def test_no_document_ends_a_job(spark):
    documents = ['{"score":1' + "0" * 400 + "}", "[" * 50000 + "]" * 50000, '{"a":' * 900 + '{"score":"7.5"}' + "}" * 900,
                 '{"score":', "", None, '{"score":1' + "0" * 400 + ',"cvss_x":"4.5","level":"LOW"}']
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, d string")
    found = {r.i: r.s for r in frame.select("i", S.advisory_json_severity(F.col("d")).alias("s")).collect()}
    assert [found[i].score for i in range(7)] == [None, None, 7.5, None, None, None, 4.5]
    assert found[6].label == "LOW"


def test_osv_documents(spark):
    document = """{"id":"O-1","summary":"s","affected":[
      {"package":{"ecosystem":"PyPI","name":"p"},"versions":["0.1"],"ranges":[
        {"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"1.2"},{"introduced":"2.0"}]},
        {"type":"GIT","events":[{"introduced":"abc"}]},
        {"type":"SEMVER","events":[{"introduced":"3"},{"last_affected":"3.4"}]}]},
      {"package":{"ecosystem":"npm","name":"q"}}]}"""
    rows = {
        r.package: r
        for r in parse_advisories(spark.createDataFrame([(document,)], "raw_json string")).collect()
    }
    assert [tuple(s) for s in rows["p"].affected] == [
        ("0", "1.2"), ("2.0", None), ("3", "3.4.0.0.0.1"),
    ]
    assert rows["q"].affected == [] and rows["q"].versions == [] and rows["q"].aliases == []


def _much_advised(spark):
    """One package with 200 advisories, listed in 40 versions of every kind; another with one."""
    releases = [f"{i % 5}.{i % 3}{kind}" for i in range(15) for kind in ("", "rc1", ".dev2")]
    versions = [*releases, "0", "9.9", "1.*", "x", None]
    lists = [("r", "requirements.txt", i, "pkg" if i % 9 else "Pkg", v, "PyPI") for i, v in enumerate(versions)]
    lists += [("r", "requirements.txt", 900, "one", "1.0", "PyPI"), ("r", "requirements.txt", 901, "none", "1.0", "PyPI")]
    deps = spark.createDataFrame(
        lists, "repo string, dep_file string, pos int, package string, version string, ecosystem string"
    )
    rows = [
        (f"A{i}", "PyPI", "PKG", [(None if i % 4 else f"{i % 3}.1", None if i % 7 == 0 else f"{i % 5}.{i % 4}rc1")],
         ["4.2", "x"] if i % 50 == 0 else [])
        for i in range(200)
    ]
    rows.append(("B", "PyPI", "one", [("0", "2.0")], []))
    rated = spark.createDataFrame(
        rows, "id string, ecosystem string, package string, "
        "affected array<struct<introduced: string, fixed: string>>, versions array<string>",
    ).withColumns({c: F.lit(None).cast("string") for c in ("summary", "severity", "published")})
    return deps, rated.withColumn("aliases", F.array().cast("array<string>"))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("deal", [4_000_000, 5])
def test_many_advisories_of_a_package_meet_cells_not_versions(spark, monkeypatch, how, deal):
    monkeypatch.setattr(D, "DEAL", deal, raising=False)
    deps, rated = _much_advised(spark)
    found = D.dependency_vulnerabilities(deps, rated, how)
    name = lambda frame: frame.select("*", F.lower("package").alias("p"))
    d, a = name(deps).alias("d"), name(rated).alias("a")
    covered = V.affects(V.span_keys(F.col("a.affected")), F.col("a.versions"), F.col("d.version"))
    tried = d.join(a, (F.col("d.p") == F.col("a.p")) & covered, how).select("pos", "d.package", "version", "id")
    key = lambda r: (r.pos, r.package, r.version or "", r.id or "")
    columns = found.select("pos", "package", "version", "id")
    assert sorted(map(key, columns.collect())) == sorted(map(key, tried.collect()))
    # nothing that makes the rows of the large package tests a version
    plan = columns.where("package = 'pkg'")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_cell" in line]
    assert joins and not any("exists(" in line for line in joins)


@pytest.mark.parametrize("how, together, deal", [("left", 512, 4_000_000), ("inner", 7, 4_000_000), ("left", 7, 5)])
def test_advisories_of_a_cell_meet_a_dependency_as_arrays(spark, monkeypatch, how, together, deal):
    """Rows are made behind the join, of the columns asked for, all of one advisory."""
    monkeypatch.setattr(D, "DEAL", deal)
    monkeypatch.setattr(D, "TOGETHER", together, raising=False)
    deps, rated = _much_advised(spark)
    rated = rated.withColumns({
        "summary": F.when(F.col("id") != "A7", F.concat(F.lit("about "), "id")), "severity": F.concat(F.lit("s"), "id"),
        "aliases": F.array("id", F.lit("x")), "score": F.length("id"),
    })
    deps = deps.withColumn("version", F.when(F.col("pos") % 2 == 0, "*").otherwise(F.col("version")))
    found = D.dependency_vulnerabilities(deps, rated, how, extra=["score"])
    rows = found.collect()
    clean = [r for r in rows if r.id is None]
    assert ("none" in {r.package for r in clean}) == (how == "left") and (how == "left" or not clean)
    assert all(r.summary is None and r.score is None for r in clean)
    for r in rows:
        if r.id is not None:
            summary = D.NO_SUMMARY if r.id == "A7" else f"about {r.id}"
            assert (r.summary, r.severity, r.aliases, r.score) == (summary, f"s{r.id}", [r.id, "x"], len(r.id))
    every = [r.id for r in rows if r.pos == 2]
    assert len(every) == len(set(every)) == 200  # not pinned: all of its package, once
    plan = found.select("pos", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "severity" not in plan.split("posexplode")[-1].split("Join")[0]
    collected = [line for line in plan.splitlines() if "collect_list" in line]
    assert len(collected) == 1 and collected[0].count("collect_list") == 2  # numbers and ids
