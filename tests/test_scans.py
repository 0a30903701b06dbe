import pytest
from pyspark.sql import functions as F

from forgelens.functions import registries as R
from forgelens.operators import scans, tallies
from harness.snippets import ALNUM

POSITIVE = {
    "PY-001": "result = eval(user_input)",
    "PY-002": "exec(open('script.py').read())",
    "PY-003": "subprocess.call(command, shell = True)",
    "PY-004": "obj = pickle.load(handle)",
    "PY-005": "conf = yaml.load(text)",
    "PY-006": "hashlib.md5(value)",
    "PY-007": "hashlib.sha1(value)",
    "PY-008": "os.system(command)",
    "PY-009": "name = tempfile.mktemp()",
    "PY-010": "__import__(module)",
    "JV-001": "Runtime.getRuntime().exec(command);",
    "JV-002": "new ProcessBuilder(list);",
    "JV-003": 'st.executeUpdate("DELETE FROM t WHERE a=" + b);',
    "JV-004": "new ObjectInputStream(stream);",
    "JV-005": "Class.forName(name);",
    "JV-006": "f.setAccessible( true );",
    "JV-007": "MessageDigest.getInstance('md5');",
    "JV-008": 'MessageDigest.getInstance("SHA-1");',
    "JV-009": 'Cipher.getInstance("DES/ECB");',
    "JV-010": "http.csrf().disable()",
    "JV-011": "new Random()",
    "JV-012": "Statement s = c.createStatement( );",
}


def _suffix(rule_id):
    return ".py" if rule_id.startswith("PY") else ".java"


def test_every_dangerous_rule_fires_in_its_language_only(make_files):
    rows = [(f"own/{i}{_suffix(i)}", line) for i, line in POSITIVE.items()]
    other = {".py": ".java", ".java": ".py"}
    rows += [(f"other/{i}{other[_suffix(i)]}", line) for i, line in POSITIVE.items()]
    rows += [(f"none/{i}.js", line) for i, line in POSITIVE.items()]
    found = {(r.file, r.id) for r in scans.dangerous_scan(make_files(rows)).collect()}
    assert {(f"own/{i}{_suffix(i)}", i) for i in POSITIVE} <= found
    languages = {".py": "PY", ".java": "JV"}
    assert all(i.startswith(languages["." + f.rsplit(".", 1)[1]]) for f, i in found)


def test_dangerous_negatives(make_files):
    rows = [
        ("a.py", "subprocess.run(['ls', '-la'], shell=False)"),
        ("b.py", "import hashlib\nhashlib.sha256(x)\njson.loads(y)"),
        ("c.py", "eval\n(x)"),  # not on one line
        ("d.py", "cfg = yaml.load(s) # Loader=yaml.SafeLoader"),
        ("e.py", ""),
        ("f.py", None),
    ]
    assert scans.dangerous_scan(make_files(rows)).count() == 0


def test_first_line_of_a_rule_wins_and_snippet_is_cut(make_files):
    text = "x\n  eval(" + "y" * 300 + ")\neval(z)\nos.system(a)"
    rows = scans.dangerous_scan(make_files([("a.py", text)])).collect()
    by_id = {r.id: r for r in rows}
    assert by_id["PY-001"].line == 2 and by_id["PY-008"].line == 4
    assert by_id["PY-001"].snippet == "eval(" + "y" * 155
    assert by_id["PY-001"].title == "eval() — Arbitrary Code Execution"
    assert by_id["PY-001"].owasp == "A03:Injection"


def test_safe_loader_inside_the_call_is_flagged(make_files):
    rows = [("a.py", "yaml.load(s, Loader=yaml.SafeLoader)")]
    assert [r.id for r in scans.dangerous_scan(make_files(rows)).collect()] == ["PY-005"]


@pytest.mark.parametrize(
    "line, pattern",
    [
        ("k = 'AKIA" + "A" * 16 + "'", "AWS Access Key ID"),
        ("aws_secret = '" + ALNUM[:40] + "'", "AWS Secret Access Key"),
        ("apikey: '" + ALNUM[:20] + "'", "Generic API Key"),
        ("BEARER abc", "Generic Bearer Token"),
        ("-----BEGIN PRIVATE KEY-----", "Private RSA Key Header"),
        ("ghp_" + ALNUM[:36], "GitHub Personal Token"),
        ("xoxb-" + "1" * 11 + "-" + "2" * 11 + "-" + ALNUM[:24], "Slack Bot Token"),
        ("AIza" + ALNUM[:35], "Google API Key"),
        ("sk_live_" + ALNUM[:24], "Stripe Secret Key"),
        ("pwd = 'abcdef'", "Generic Password"),
    ],
)
def test_secret_patterns(make_files, line, pattern):
    files = make_files([("a.py", "one\ntwo\n" + line + "\n")])
    rows = scans.secret_scan(files).collect()
    assert [(r.pattern, r.lineno) for r in rows] == [(pattern, 3)]


def test_secret_lines_masks_and_counts(make_files):
    both = "  ghp_" + ALNUM[:36] + " password = 'hushhush' " + "z" * 300
    files = make_files(
        [("a.py", f"{both}\r\nclean\r\npasswd='another one'"), ("b.py", "x = 1"), ("c.py", "")]
    )
    rows = sorted(scans.secret_scan(files).collect(), key=lambda r: r.lineno)
    assert [r.pattern for r in rows] == ["GitHub Personal Token", "Generic Password"]
    assert "hushhush" not in rows[0].snippet and "'***MASKED***'" in rows[0].snippet
    assert len(rows[0].snippet) == 200
    assert rows[1].snippet == "passwd='***MASKED***'"
    strict = scans.secret_scan(files, strict_mask=True).orderBy("lineno").collect()
    assert "ghp_" not in strict[0].snippet
    counts = {r.path: r.finding_count for r in scans.secret_counts(files).collect()}
    assert counts == {"a.py": 2, "b.py": 0, "c.py": 0}


def _rating(make_files, repos_of, rows):
    files = make_files(rows)
    row = tallies.attack_surface_rating(repos_of("r"), files).first()
    return row.total, row.rating


def test_attack_surface_counts_files(make_files, repos_of):
    rows = [
        ("a.py", "@app.route('/x')\n@app.route('/y')\nrequest.files['f']"),
        ("b.java", "@RestController\npublic class UserController {}"),
        ("c.py", "cursor.execute('SELECT * FROM t')"),
        ("d.py", None),
    ]
    files = make_files(rows)
    counts = {
        r.category: r.n for r in tallies.attack_surface(repos_of("r", "empty"), files)
        .where("repo = 'r'").collect()
    }
    assert counts == dict.fromkeys(R.ATTACK_SURFACE_PATTERNS, 0) | {
        "rest_endpoints": 1, "file_uploads": 1, "controllers": 1, "db_access": 1,
    }
    assert tallies.attack_surface(repos_of("r", "empty"), files).count() == 14


def test_rating_ladder(make_files, repos_of):
    route = lambda n: [(f"r{i}.py", "@app.route('/x')") for i in range(n)]
    db = lambda n: [(f"d{i}.py", ".filter (x)") for i in range(n)]
    upload = lambda n: [(f"u{i}.py", "request.files") for i in range(n)]
    rate = lambda rows: _rating(make_files, repos_of, rows)
    assert rate([("x.py", "pass")]) == (0, "LOW")
    assert rate(route(12)) == (12, "HIGH")
    assert rate(route(5) + db(3)) == (8, "HIGH")
    assert rate(upload(3)) == (3, "HIGH")
    assert rate(route(5) + db(1)) == (6, "MEDIUM")
    assert rate(db(2)) == (2, "MEDIUM")
    assert rate(route(2)) == (2, "LOW")


def _smells(make_files, rows):
    kinds = [scans.DANGEROUS, scans.SURFACE, scans.SMELL]
    return tallies.smells(scans.scan_files(make_files(rows), kinds)).collect()


def test_file_smells(make_files):
    rows = [
        ("auth_a.py", "x\n" * 501),
        ("auth_b.py", "x\n" * 500),
        ("big.py", "x\n" * 600),
        ("v.py", "freemarker velocity"),
        ("q.py", 'q = "SELECT a\nFROM t" + x'),
        ("p.java", ".permitAll()"),
        ("p2.java", ".permitall()"),
        ("r3.java", "Class.forName(a) Class.forName(b) getDeclaredMethod"),
        ("r2.java", "Class.forName(a) getDeclaredMethod"),
    ]
    found = {(r.file, r.title, r.severity) for r in _smells(make_files, rows)}
    assert found == {
        ("auth_a.py", "God Security Object", "Medium"),
        ("v.py", "Legacy Template Engine: Velocity", "Medium"),
        ("q.py", "Dynamic SQL Construction", "High"),
        ("p.java", "Disabled Security Access Control", "High"),
        ("r3.java", "Excessive Reflection Usage", "Medium"),
    }


def test_repository_smells(make_files):
    crypto = [(f"c{i}.py", "hashlib.md5(x)") for i in range(3)]
    surface = [(f"s{i}.py", "@app.route('/x')") for i in range(5)]
    surface += [(f"u{i}.py", "request.files") for i in range(2)]
    rows = _smells(make_files, crypto + surface)
    assert {(r.title, r.file) for r in rows} == {
        ("Density of Weak Cryptography", None),
        ("Concentrated Attack Surface Danger", None),
    }
    assert any(r.detail.startswith("3 instances of weak cryptography") for r in rows)
    assert _smells(make_files, crypto[:2] + surface[1:]) == []


def test_scan_reads_content_once_and_never_shuffles(make_files):
    hits = scans.scan_files(make_files([("a.py", "eval(x)")]))
    plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "Join" not in plan


def test_one_repository_with_most_files_is_counted_right(make_files, spark):
    rows = [("hot", f"f{i}.py", "eval(x)\npassword = 'secret99'") for i in range(400)]
    rows += [("cold", "a.py", "eval(x)")]
    hits = scans.scan_files(make_files(rows).repartition(8))
    counts = {r.repo: r for r in tallies.tally_hits(hits).collect()}
    assert counts["hot"].PY_001 == 400 and counts["hot"].secret_10 == 400
    assert counts["cold"].PY_001 == 1 and counts["cold"].secret_10 == 0
    partial = tallies.tally_hits(hits)
    plan = partial._sc._jvm.PythonSQLUtils.explainString(partial._jdf.queryExecution(), "simple")
    assert "partial_count" in plan


def test_kinds_can_be_limited_to_some_files(make_files):
    files = make_files([("a.py", "eval(x)\npassword = 'secret99'"), ("b.py", "eval(x)")])
    applies = {scans.SECRET: F.col("path") == "b.py", scans.DANGEROUS: F.col("path") == "a.py"}
    hits = scans.scan_files(files, [scans.SECRET, scans.DANGEROUS], applies).collect()
    assert [(h.kind, h.path) for h in hits] == [("dangerous", "a.py")]
