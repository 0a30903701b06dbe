"""Audit tables derived from the driver's parquet tables, in Spark."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snippets as S

LF = "\n"
AS_OF = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Hash-spreads a scan over the session's cores, whatever its number of splits.

    The small test tables are one row group each, which one task would read and then
    process alone.  A table of as many files as there are cores is read by all of them as it
    is; whole texts are not written to disk for that.
    """
    if len(frame.inputFiles()) >= frame.sparkSession.sparkContext.defaultParallelism:
        return frame
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism, key)


def pick(values: list[str], number: Column) -> Column:
    entries = F.array(*[F.lit(v) for v in values])
    return F.element_at(entries, (number % len(values) + 1).cast("int"))


def documents(spark, sf_dir, *columns) -> DataFrame:
    frame = read(spark, sf_dir, "documents").select("doc_id", "source", *columns)
    return spread(frame, "doc_id")


def _stem(doc_id: Column) -> Column:
    kind = doc_id % 31
    return (
        F.when(kind == 3, F.concat(F.lit("p"), doc_id, F.lit("/__init__")))
        .when(kind == 4, F.concat(F.lit("config_"), doc_id))
        .when(kind == 6, F.concat(F.lit("latest_"), doc_id))
        .otherwise(F.concat(F.lit("mod_"), doc_id))
    )


def _directory(doc_id: Column) -> Column:
    return pick(S.DIRECTORIES, doc_id)


def code_path(doc_id: Column) -> Column:
    return F.concat(_directory(doc_id), _stem(doc_id), pick(S.EXTENSIONS, doc_id))


def py_path(doc_id: Column) -> Column:
    return F.concat(_directory(doc_id), _stem(doc_id), F.lit(".py"))


def code_files(spark, sf_dir) -> DataFrame:
    """Every document as a source file, plus root dependency files and directories."""
    doc_id = F.col("doc_id")
    docs = documents(spark, sf_dir, "text")
    filler = F.when(doc_id % 29 == 5, F.repeat(F.lit("x = 1" + LF), 600)).otherwise("")
    content = F.concat(
        filler,
        F.concat_ws(
            LF, pick(S.WEB, doc_id), pick(S.SECRETS, doc_id), pick(S.CODE, doc_id), F.col("text")
        ),
    )
    blobs = docs.select(
        F.col("source").alias("repo"),
        code_path(doc_id).alias("path"),
        F.lit("blob").alias("kind"),
        content.alias("content"),
    )
    narrow = read(spark, sf_dir, "documents").select("source", "doc_id")
    directories = (
        narrow.select(F.col("source").alias("repo"), _directory(doc_id).alias("path"))
        .where("path <> ''")
        .distinct()
        .select(
            "repo",
            F.rtrim("path", F.lit("/")).alias("path"),
            F.lit("tree").alias("kind"),
            F.lit("").alias("content"),
        )
    )
    number = repo_number(F.col("repo"))
    present = F.filter(
        F.array(
            F.when(number % 2 == 0, "requirements.txt"),
            F.when(number % 3 == 0, "package.json"),
            F.when(number % 5 == 0, "pom.xml"),
            F.when(number % 4 == 1, "pyproject.toml"),
        ),
        lambda name: name.isNotNull(),
    )
    roots = (
        repo_names(spark, sf_dir)
        .select("repo", F.explode(present).alias("path"))
        .select(
            "repo",
            "path",
            F.lit("blob").alias("kind"),
            F.when(F.col("path") == "pyproject.toml", pyproject(number))
            .otherwise(requirements(number))
            .alias("content"),
        )
    )
    return (
        blobs.unionByName(directories)
        .unionByName(roots)
        .withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    )


def earlier_files(files: DataFrame) -> DataFrame:
    """The files before some were added, edited and moved, and before others were deleted."""
    kind = F.pmod(F.xxhash64("repo", "path"), F.lit(10))
    blob = F.col("kind") == "blob"
    root = ~F.contains("path", F.lit("/"))
    edited = F.concat(F.lit("password = 'hunter22'" + LF + "x==1.0" + LF), F.col("content"))
    before = files.where((kind != 0) | ~blob).withColumns(
        {
            "content": F.when(blob & (kind == 1), edited).otherwise(F.col("content")),
            "path": F.when(blob & ~root & (kind == 2), F.concat(F.lit("src/old/"), "path")).otherwise(F.col("path")),
        }
    )
    deleted = files.where(blob & (kind == 3)).withColumn("path", F.concat(F.lit("gone/"), "path"))
    return before.unionByName(deleted)


def repo_number(repo: Column) -> Column:
    return F.regexp_extract(repo, r"([0-9]+)$", 1).cast("int")


def repo_names(spark, sf_dir) -> DataFrame:
    return (
        read(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    )


def requirements(number: Column) -> Column:
    """A requirements text of 25 packages with a comment, a blank line and an option."""
    body = F.array_join(specs(number), LF)
    return F.concat(F.lit("# generated" + LF + LF + "-r base.txt" + LF), body, F.lit(LF))


def pyproject(number: Column) -> Column:
    """The same packages as a project file, with other keys and comments around them."""
    quoted = F.transform(specs(number), lambda s: F.concat(F.lit('    "'), s, F.lit('",')))
    return F.concat(
        F.lit(S.PYPROJECT_HEAD), F.array_join(quoted, LF), F.lit(LF + S.PYPROJECT_TAIL)
    )


def specs(number: Column) -> Column:
    version = lambda i: F.concat(i % 6, F.lit("."), (i + number) % 10)
    line = lambda i: F.concat(
        F.lit("pkg"),
        (number * 7 + i * 13) % 200,
        F.when(i % 6 == 0, F.concat(F.lit("=="), version(i)))
        .when(i % 6 == 1, F.concat(F.lit(">="), version(i)))
        .when(i % 6 == 2, F.concat(F.lit("[extra]~="), version(i)))
        .when(i % 6 == 3, F.concat(F.lit(" == "), version(i), F.lit("  # note")))
        .when(i % 6 == 4, F.concat(F.lit("=="), i, F.lit(".*")))
        .otherwise(""),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(24)), line)


def listed_paths(spark, sf_dir) -> DataFrame:
    """Every fifth document of even repositories as a file to analyse, the last ones first."""
    return read(spark, sf_dir, "documents").where((repo_number(F.col("source")) % 2 == 0) & (F.col("doc_id") % 5 == 0)).select(
        F.col("source").alias("repo"), code_path(F.col("doc_id")).alias("path"), (-F.col("doc_id")).alias("pos")
    )


def repos(spark, sf_dir) -> DataFrame:
    number = repo_number(F.col("repo"))
    return repo_names(spark, sf_dir).select(
        "repo",
        F.lit("main").alias("default_branch"),
        (number * 10).alias("stars"),
        F.when(number % 2 == 0, "Python").otherwise("Java").alias("language"),
    )


def py_files(spark, sf_dir) -> DataFrame:
    """Every document as a Python file: a snippet, then the text as comments."""
    doc_id = F.col("doc_id")
    comments = F.replace(F.col("text"), F.lit(LF), F.lit(LF + "# "))
    return (
        documents(spark, sf_dir, "text")
        .select(
            F.col("source").alias("repo"),
            py_path(doc_id).alias("path"),
            F.lit("blob").alias("kind"),
            F.concat(pick(S.PYTHON, doc_id), F.lit(LF + "# "), comments).alias("content"),
        )
        .withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    )


def text_files(spark, sf_dir) -> DataFrame:
    """Documents as they are, for duplication; a language is a repository."""
    return documents(spark, sf_dir, "text", "lang").select(
        F.col("lang").alias("repo"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


def commits(spark, sf_dir) -> DataFrame:
    """Events as commits to the Python file of their user's document."""
    owners = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"), F.col("source").alias("repo")
    )
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return events.join(owners, "user_id").select(
        "repo",
        py_path(F.col("user_id")).alias("path"),
        F.col("event_id").cast("string").alias("sha"),
        F.col("ts").alias("author_date"),
        F.col("event_type").alias("message"),
    )


def respelled_dep_lines(spark, sf_dir) -> DataFrame:
    """The lines of :func:`dep_lines`, their packages in three other spellings."""
    form = F.col("l_linenumber_") % 3
    name = F.when(form == 0, "PKG-").when(form == 1, "Pkg__").otherwise("pkg.-_")
    lines = dep_lines(spark, sf_dir).withColumn("l_linenumber_", F.col("pos") % 10)
    return lines.withColumn("line", F.replace(F.col("line"), F.lit("pkg"), name)).drop(
        "l_linenumber_"
    )


def respelled_advisories(spark, sf_dir) -> DataFrame:
    named = F.replace(F.col("package"), F.lit("pkg"), F.lit("Pkg_"))
    return advisories(spark, sf_dir).withColumn("package", named)


def dep_lines(spark, sf_dir) -> DataFrame:
    """Order lines as requirement lines of their supplier."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    lines = spread(lines, "l_orderkey")
    package = F.concat(F.lit("pkg"), F.col("l_partkey"))
    major = F.col("l_quantity").cast("int") % 6
    minor = F.col("l_orderkey") % 10
    form = F.col("l_linenumber") % 7
    line = (
        F.when(form == 0, F.concat(package, F.lit("=="), major, F.lit("."), minor, F.lit(".0")))
        .when(form == 1, F.concat(package, F.lit(">="), major, F.lit("."), minor))
        .when(form == 2, F.concat(package, F.lit("[extra]~="), major, F.lit("."), minor))
        .when(form == 3, package)
        .when(form == 4, F.concat(F.lit("# "), package, F.lit("=="), major))
        .when(form == 5, F.concat(package, F.lit(" == "), major, F.lit(".*")))
        .otherwise(F.concat(F.lit("  -r "), package, F.lit(".txt")))
    )
    return lines.select(
        F.concat(F.lit("supplier"), "l_suppkey").alias("repo"),
        F.lit("requirements.txt").alias("dep_file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        line.alias("line"),
    )


def release_lines(spark, sf_dir) -> DataFrame:
    """Order lines as requirement lines with versions of every kind, spelled in three ways."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    lines = spread(lines, "l_orderkey")
    order, part, quantity = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("int")
    spelled = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (part % 3 + 1).cast("int"))
    minor = order % 3
    separator = spelled("", "-", ".")
    kind = part % 5
    pre = F.when(kind == 1, spelled("a", "ALPHA", "alpha")).when(kind == 2, spelled("b", "Beta", "beta")).when(
        kind == 3, spelled("rc", "c", "preview")
    )
    version = F.concat(
        F.when(order % 17 == 0, "v").otherwise(""),
        F.when(order % 11 == 0, "1!").otherwise(""),
        quantity % 3,
        F.when((order % 2 == 0) & (minor == 0), "").otherwise(F.concat(F.lit("."), minor)),
        F.when(order % 5 == 0, ".0").otherwise(""),
        F.coalesce(F.concat(separator, pre, separator, F.expr("l_partkey div 5 % 12")), F.lit("")),
        F.when(order % 7 == 0, F.concat(F.when(part % 2 == 0, ".post").otherwise("-"), part % 3)).otherwise(""),
        F.when(order % 6 == 1, F.concat(F.lit(".dev"), quantity % 12)).otherwise(""),
        F.when(order % 13 == 5, F.concat(F.lit("+"), F.col("l_linenumber"))).otherwise(""),
    )
    return lines.select(
        F.concat(F.lit("order"), order % 100).alias("repo"),
        F.lit("requirements.txt").alias("dep_file"),
        (order * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit("pkg"), part % 30, F.lit("=="), version).alias("line"),
    )


def release_advisories(spark, sf_dir) -> DataFrame:
    """Parts as advisories whose ranges end at pre-releases and development releases."""
    key, size = F.col("p_partkey"), F.col("p_size")
    fixed = F.concat(size % 3, F.lit("."), key % 3, F.when(key % 2 == 0, "rc").otherwise(".dev"), size % 12)
    return read(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(
        F.concat(F.lit("ADV-"), key).alias("id"),
        F.lit("PyPI").alias("ecosystem"),
        F.concat(F.lit("PKG"), key % 30).alias("package"),
        F.array(F.struct(F.when(size % 4 == 0, "1.0a1").alias("introduced"), fixed.alias("fixed"))).alias("affected"),
        F.array().cast("array<string>").alias("versions"),
        *[F.lit(None).cast("string").alias(c) for c in ("summary", "details", "published")],
        F.array().cast("array<string>").alias("aliases"),
        F.lit(None).cast("string").alias("raw_json"),
    )


def advisories(spark, sf_dir) -> DataFrame:
    """Parts as advisories; three parts share a package."""
    key, size = F.col("p_partkey"), F.col("p_size")
    version = lambda n: F.concat((n / 10).cast("int"), F.lit("."), n % 10, F.lit(".0"))
    introduced = F.when(size % 2 == 0, "0").otherwise(version(size))
    fixed = F.when(size % 5 != 0, version(size + 7))
    documents_ = [
        '{"id":"x"}',
        '{"severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"}],'
        '"database_specific":{"severity":"HIGH"}}',
        None,
        '{"database_specific":{"severity":"MODERATE"}}',
        '{"a":{"b":[{"score":"9.8"}]}}',
        '{"level":"weird"}',
    ]
    hostile = (
        F.when(key % 97 == 0, F.concat(F.lit('{"score":1'), F.repeat(F.lit("0"), 400), F.lit("}")))
        .when(key % 97 == 1, F.concat(F.repeat(F.lit("["), 30000), F.repeat(F.lit("]"), 30000)))
        .when(key % 97 == 2, '{"score":')
    )
    scored = F.concat(
        F.lit('{"database_specific":{"cvss_score":'), size / 5.0, F.lit("}}")
    )
    raw = F.coalesce(hostile, F.element_at(F.array(*[F.lit(d) for d in documents_]),
                                  (key % 6 + 1).cast("int")), scored)
    summary = (
        F.when(key % 5 == 0, None)
        .when(key % 5 == 1, "CVSS base score 8.1 found")
        .when(key % 5 == 3, "severity: 5.5")
        .otherwise(F.col("p_name"))
    )
    parts = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    return parts.select(
        F.concat(F.lit("ADV-"), key).alias("id"),
        F.lit("PyPI").alias("ecosystem"),
        F.concat(F.lit("pkg"), key - key % 3).alias("package"),
        F.array(F.struct(introduced.alias("introduced"), fixed.alias("fixed"))).alias("affected"),
        F.array(F.concat(size % 6, F.lit(".0.0"))).alias("versions"),
        summary.alias("summary"),
        F.lit(None).cast("string").alias("details"),
        F.when(key % 7 != 0, "2024-01-01").alias("published"),
        F.array(F.concat(F.lit("CVE-2024-"), key)).alias("aliases"),
        raw.alias("raw_json"),
    )


def event_lines(spark, sf_dir) -> DataFrame:
    """Conversation turns as JSON lines of runner events, some of them broken or with other fields."""
    turn, conv = F.col("turn"), F.col("conv_id")
    part = lambda text, call: F.struct(text.alias("text"), call.alias("function_call"))
    none = F.lit(None).cast("string")
    call = F.when(F.col("role") == "assistant", F.struct(F.concat(F.lit("tool_"), turn % 3).alias("name")))
    parts = F.array(part(F.col("text"), F.lit(None).cast("struct<name:string>")), part(none, call), part(F.lit("end"), call))
    event = F.struct(
        F.concat(F.lit("s"), conv).alias("session"),
        turn.alias("seq"),
        F.col("role").alias("author"),
        (F.col("role") == "assistant").alias("is_final"),
        F.struct(parts.alias("parts")).alias("content"),
        F.when(conv % 5 == 0, turn * 10).alias("usage"),
    )
    line = F.to_json(event)
    broken = (
        F.when(conv % 7 == 1, F.substring(line, 1, 30))
        .when(conv % 7 == 2, F.replace(line, F.lit('"session":'), F.lit('"sesion":')))
        .when(conv % 7 == 3, F.replace(line, F.lit('"seq":'), F.lit('"seq":"x"')))
    )
    return read(spark, sf_dir, "conversations").select(
        F.coalesce(F.when(turn == 1, broken), line).alias("line")
    )


def agent_events(spark, sf_dir) -> DataFrame:
    """Conversation turns as text events of an agent session."""
    role = F.col("role")
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session"),
        F.col("turn").alias("seq"),
        F.when(role == "assistant", "security_agent")
        .when(role == "user", "visitor")
        .alias("author"),
        F.lit(None).cast("string").alias("tool"),
        "text",
        (role == "assistant").alias("is_final"),
    )


def tool_events(spark, sf_dir) -> DataFrame:
    """User events as tool calls of an agent session; errors call no tool."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("agent_"), F.col("event_id") % 4))
        .alias("author"),
        F.when(kind != "error", kind).alias("tool"),
    )


def reports(spark, sf_dir) -> DataFrame:
    """A Markdown report around every document; every ninth has no headings."""
    doc_id = F.col("doc_id")
    score = lambda label, n, of: F.concat(
        F.lit(f"- {label} Score: "), doc_id % n, F.lit(of + LF)
    )
    text = F.concat(
        F.lit("# Audit Report: "), F.col("source"), F.lit(LF + "## 1. Executive Summary" + LF),
        score("Global Technical Debt", 101, "/100"),
        score("Code Quality", 41, "/40"),
        score("Security", 31, " / 30"),
        F.when(doc_id % 4 == 0, score("Repository Structure", 31, "/30")).otherwise(""),
        F.lit("### 3. Hotspots Analysis" + LF),
        F.when(doc_id % 3 == 0, "CRITICAL HOTSPOT and critical hotspot" + LF).otherwise(""),
        F.col("text"),
        F.lit(LF + "## 5. Security Analysis" + LF + "CVE-2024-"), doc_id + 1000,
        F.lit(" cve-2023-1" + LF + "## 6. Priority Action Plan" + LF + "P1" + LF),
        F.when(doc_id % 5 == 0, "### 3. Hotspots Analysis" + LF + " second " + LF).otherwise(""),
    )
    return documents(spark, sf_dir, "text").select(
        F.concat_ws("/", "source", doc_id.cast("string")).alias("repo"),
        F.when(doc_id % 9 == 0, F.col("text")).otherwise(text).alias("text"),
    )


def write_long_files(files: DataFrame, root: str) -> None:
    """One file for every 10,000 numbers of a repository's paths: its files one after another."""
    number = F.regexp_extract("path", r"_([0-9]+)[.]", 1)
    chapter = F.coalesce(F.floor(number.try_cast("bigint") / 10000), F.lit(-1))
    named = files.select("repo", chapter.alias("chapter"), "path", "content")
    ordered = named.repartition("repo", "chapter").sortWithinPartitions("repo", "chapter", "path")
    ordered.drop("path").write.partitionBy("repo", "chapter").text(root)
