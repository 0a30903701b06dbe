import json

from pyspark.sql import functions as F

from forgelens.operators import scans
from forgelens.plans.audit import SecurityAudit
from forgelens.sources import files as sources
from forgelens.sources.advisories import read_advisories
from forgelens.sources.materialize import materialize
from forgelens.sources.events import parse_events, read_event_log
from forgelens.sources.sinks import read_report, write_reports, write_tables
from forgelens.streaming.incremental import file_stream, scan_new_files

BYTES = [b"plain", b"caf\xc3\xa9", b"a\xff\xfeb", b"\xe2\x28\xa1", b"\xef\xbf\xbd\xffx", b""]


def test_invalid_bytes_are_dropped(spark):
    frame = spark.createDataFrame([(bytearray(b),) for b in BYTES], "b binary")
    for row in frame.select("b", sources.decode_text(F.col("b")).alias("t")).collect():
        assert row.t == bytes(row.b).decode("utf-8", errors="ignore"), row.b


def test_trees(spark, tmp_path):
    for path, data in {"o/r/src/a.py": b"eval(x)\xff", "o/r/b.txt": b"x", "o/q/c.py": b"1"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    rows = {(r.repo, r.path): r for r in sources.read_trees(spark, str(tmp_path)).collect()}
    assert set(rows) == {("o/r", "src/a.py"), ("o/r", "b.txt"), ("o/q", "c.py")}
    found = rows[("o/r", "src/a.py")]
    assert (found.content, found.size_bytes, found.kind) == ("eval(x)", 8, "blob")
    python = sources.read_trees(spark, str(tmp_path), "*.py")
    assert python.count() == 2
    assert scans.dangerous_scan(python).count() == 1


def test_trees_with_stray_files_and_a_root_that_recurs(spark, tmp_path):
    root = tmp_path / "src"
    for path in ("README.md", "o/notes.txt", "o/r/a.py", "o/r/src/o2/r2/b.py"):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x")
    for given in (str(root), f"file://{root}/"):
        rows = sources.read_trees(spark, given).collect()
        assert {(r.repo, r.path) for r in rows} == {("o/r", "a.py"), ("o/r", "src/o2/r2/b.py")}


def _no_advisories(spark):
    return spark.createDataFrame(
        [],
        "id string, ecosystem string, package string, affected array<struct<introduced:string,fixed:string>>, "
        "versions array<string>, summary string, details string, published string, aliases array<string>, raw_json string",
    )


def test_sinks_and_table_sources(spark, make_files, tmp_path):
    write_tables({"files": make_files([("a.py", "eval(x)")])}, str(tmp_path / "tables"))
    files = sources.read_files(spark, str(tmp_path / "tables/files"))
    assert scans.dangerous_scan(files).count() == 1


def test_reports_stand_in_files_of_bounded_size(spark, tmp_path):
    lines = spark.range(600).selectExpr(
        "concat('o/r', id % 40) as repo", "id div 40 as place", "concat('line ', id) as text"
    )
    hot = spark.range(400).selectExpr("'o/hot' as repo", "id as place", "concat('hot ', id) as text")
    path = str(tmp_path / "out")
    index = write_reports(lines.unionByName(hot).repartition(5), path, rows_per_file=100)
    files = spark.read.parquet(f"{path}/lines").groupBy(F.col("_metadata.file_name")).count().collect()
    assert max(r["count"] for r in files) <= 100 and len(files) < 30
    assert sum(r.n_lines for r in index.collect()) == 1000
    assert index.where("repo = 'o/hot'").count() >= 4
    assert read_report(spark, path, "o/hot") == "".join(f"hot {i}\n" for i in range(400))
    assert read_report(spark, path, "o/r7") == "".join(f"line {7 + 40 * i}\n" for i in range(15))
    assert read_report(spark, path, "o/none") is None
    empty = str(tmp_path / "empty")
    assert write_reports(lines.limit(0), empty).count() == 0 and read_report(spark, empty, "x") is None


EVENTS = [
    '{"session":"a","seq":1,"author":"scanner","is_final":false,"content":{"parts":[{"function_call":{"name":"t1","args":{"x":1}}},{"text":"one"},{"text":"two"}]}}',
    '{"session":"a","seq":"2","is_final":true,"content":{"parts":[{"text":"é\\nx"}]},"usage":{"n":[1,2]},"id":"e"}',
    '{"session":"b","seq":3,"is_final":"maybe","content":"plain text"}',
    '{"session":7,"seq":4}',
    '{"seq":5}', '{"session":"a","seq":1.5}', '{"session":"a","seq":null}', "[1]", "oops", '{"session":"a","seq":6', "null",
    "", "   ", '{"session":"a","seq":7}\r',
]


def test_event_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(EVENTS[:6]) + "\n")
    (tmp_path / "more.jsonl").write_text("\n".join(EVENTS[6:]))
    rows = read_event_log(spark, str(tmp_path)).collect()
    good = {(r.session, r.seq): r for r in rows if r.error is None}
    assert good.keys() == {("a", 1), ("a", 2), ("b", 3), ("7", 4), ("a", 7)}
    first, second, third = good[("a", 1)], good[("a", 2)], good[("b", 3)]
    assert (first.author, first.text, first.tool, first.tools, first.is_final) == ("scanner", "one\ntwo", "t1", ["t1"], False)
    assert (second.author, second.text, second.tool, second.is_final) == (None, "é\nx", None, True)
    assert json.loads(second.rescued) == {"usage": '{"n":[1,2]}', "id": "e"} and first.rescued is None
    assert json.loads(third.rescued) == {"is_final": "maybe", "content": "plain text"} and third.text is None
    bad = {r.bad_line: r.error for r in rows if r.error is not None}
    assert bad == {
        '{"seq":5}': "no session", '{"session":"a","seq":1.5}': "no whole number as seq",
        '{"session":"a","seq":null}': "no whole number as seq", "[1]": "no JSON object", "oops": "no JSON object",
        '{"session":"a","seq":6': "no JSON object", "null": "no JSON object",
    }
    assert all(r.session is None and r.text is None for r in rows if r.error is not None)
    assert parse_events(spark.createDataFrame([], "line string")).count() == 0


def test_advisory_files(spark, tmp_path):
    document = '{"id":"O-%s",\n"affected":[{"package":{"ecosystem":"PyPI","name":"p"}}]}'
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(document % name)
    assert {r.id for r in read_advisories(spark, str(tmp_path)).collect()} == {"O-a", "O-b"}


def test_materialized_frame_is_equal(spark):
    frame = spark.range(10).withColumn("x", F.array(F.col("id")))
    written = materialize(frame, "numbers")
    assert written.dtypes == frame.dtypes
    assert sorted(r.id for r in written.collect()) == list(range(10))


def test_stream_finds_what_the_batch_finds(spark, make_files, tmp_path):
    text = "eval(x)\npassword = 'secret99'"
    first = make_files([("a.py", "eval(x)"), ("b.py", text), ("tests/t.py", text), ("vendor/v.py", text)])
    second = make_files([("c.py", "os.system(x)"), ("d.txt", text), ("e.java", text), ("node_modules/n.py", text)])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        scan_new_files(file_stream(spark, source, 1), out, str(tmp_path / "cp")).awaitTermination()
    both = first.unionByName(second)
    repos = spark.createDataFrame([("r", "main", 1, "Python")], "repo string, default_branch string, stars int, language string")
    expected = SecurityAudit(repos, both, _no_advisories(spark)).hits
    assert {r.path for r in expected.collect()} == {"a.py", "b.py", "c.py", "node_modules/n.py"}
    found = spark.read.parquet(out)
    columns = expected.columns
    assert sorted(map(str, found.select(columns).collect())) == sorted(
        map(str, expected.collect())
    )


def test_texts_of_many_files_are_not_shuffled(spark, tmp_path):
    """A table of one file is dealt out to the cores; one of as many files as cores is read as it is, all rows of it."""
    from harness import tables

    rows = spark.range(40).selectExpr("id AS doc_id", "concat('src', id % 3) AS source", "concat('text ', id) AS text")
    for files in (1, spark.sparkContext.defaultParallelism):
        rows.repartition(files).write.parquet(f"{tmp_path}/{files}/documents.parquet")
        read = tables.documents(spark, f"{tmp_path}/{files}", "text")
        assert sorted(read.collect()) == sorted(rows.select(read.columns).collect())
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert ("Repartition" in plan) == (files == 1)
