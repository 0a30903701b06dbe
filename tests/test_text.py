from pyspark.sql import functions as F

from forgelens.functions import text as T

TEXTS = [
    "", "\n", "a", "a\n", "a\r\nb", "a\rb\n\nc", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed",
    "a\x85b", "x y ", "\r\n\r\n", "one\ntwo\n", "\n\na", "é\nü",
]
PADDED = ["  a ", "\t\x0b a\xa0", " a b　", "\x1c\x1fa\x85", "", "   ", "a", "﻿a"]


def test_lines_and_counts_equal_splitlines(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = frame.select(
        "t", T.lines(F.col("t")).alias("lines"), T.line_count(F.col("t")).alias("n")
    ).collect()
    for row in rows:
        assert row.lines == row.t.splitlines(), repr(row.t)
        assert row.n == len(row.t.splitlines()), repr(row.t)


def test_strip_equals_python(spark):
    frame = spark.createDataFrame([(t,) for t in PADDED], "t string")
    for row in frame.select("t", T.strip(F.col("t")).alias("s")).collect():
        assert row.s == row.t.strip(), repr(row.t)


def test_whitespace_is_all_there_is():
    assert set(T.WHITESPACE) == {chr(c) for c in range(0x3100) if chr(c).isspace()}


def test_path_parts(spark):
    paths = ["a.py", "a.b/c", ".gitignore", "Makefile", "x/y/Z.kt", "A.PY", "a.groovy", "b.js"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    rows = frame.select(
        "p", T.extension(p).alias("e"), T.language(p).alias("l"), T.depth(p).alias("d")
    ).collect()
    assert {r.p: r.e for r in rows} == {
        "a.py": "py", "a.b/c": "b/c", ".gitignore": "gitignore", "Makefile": None,
        "x/y/Z.kt": "kt", "A.PY": "PY", "a.groovy": "groovy", "b.js": "js",
    }
    assert {r.p: r.l for r in rows if r.l != "any"} == {
        "a.py": "python", "x/y/Z.kt": "java", "a.groovy": "java",
    }
    assert {r.p: r.d for r in rows}["x/y/Z.kt"] == 2
