"""Logs of runner events as JSON lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an event that are read; what else a line holds is kept as it is.
KNOWN = ("session", "seq", "author", "is_final", "content")
CONTENT = "struct<parts:array<struct<text:string,function_call:struct<name:string>>>>"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Agent events from the files below ``path``, one JSON object a line; see :func:`parse_events`.

    Files are split between lines; files ending in .gz are read whole by one task each.
    """
    return parse_events(spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line"))


def parse_events(lines: DataFrame) -> DataFrame:
    """``lines(line)`` to (session, seq, author, tool, text, is_final, tools, rescued, bad_line, error).

    An event holds ``session``, ``seq``, ``author``, ``is_final`` and ``content``, whose
    parts are texts and function calls.  ``text`` joins its texts by line feeds, ``tools``
    are the names it calls and ``tool`` the first of them; an event without text or calls
    has null there.  ``rescued`` holds all other fields, and known ones of an unexpected
    kind, as JSON.  A line that is no JSON object, or that has no session or whole-number
    seq, is a row with ``error`` and ``bad_line``, its other columns null; blank lines are
    left out.  No lines, no rows.
    """
    line = F.regexp_replace("line", r"\r$", "")
    fields = F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"})
    whole = F.json_object_keys("line").isNotNull()
    read = lines.select(line.alias("line")).where(F.trim("line") != "")
    read = read.withColumn("_f", F.when(whole, fields))
    named = {name: F.try_element_at("_f", F.lit(name)) for name in KNOWN}
    seq, final = named["seq"].try_cast("bigint"), named["is_final"].try_cast("boolean")
    content = F.from_json(named["content"], CONTENT)
    error = (
        F.when(F.col("_f").isNull(), "no JSON object")
        .when(named["session"].isNull(), "no session")
        .when(seq.isNull(), "no whole number as seq")
    )
    parsed = read.withColumns({"_seq": seq, "_final": final, "_content": content, "error": error})
    odd = {
        "is_final": F.col("_final").isNull() & named["is_final"].isNotNull(),
        "content": F.col("_content.parts").isNull() & named["content"].isNotNull(),
    }
    rest = F.map_filter(
        "_f",
        lambda k, v: ~k.isin(*KNOWN) | (k == "is_final") & odd["is_final"] | (k == "content") & odd["content"],
    )
    texts = F.filter(F.transform("_content.parts", lambda p: p["text"]), lambda t: t.isNotNull())
    tools = F.filter(F.transform("_content.parts", lambda p: p["function_call"]["name"]), lambda n: n.isNotNull())
    good = F.col("error").isNull()
    shown = lambda value: F.when(good, value)
    return parsed.withColumns({"_texts": texts, "_tools": tools, "_rest": rest}).select(
        shown(named["session"]).alias("session"),
        shown(F.col("_seq")).alias("seq"),
        shown(named["author"]).alias("author"),
        shown(F.get("_tools", F.lit(0))).alias("tool"),
        shown(_none_if_empty(F.col("_texts"), F.array_join("_texts", "\n"))).alias("text"),
        shown(F.coalesce("_final", F.lit(False))).alias("is_final"),
        shown(_none_if_empty(F.col("_tools"), F.col("_tools"))).alias("tools"),
        shown(F.when(F.size(F.map_keys("_rest")) > 0, F.to_json("_rest"))).alias("rescued"),
        F.when(~good, F.col("line")).alias("bad_line"),
        "error",
    )


def _none_if_empty(values: Column, shown: Column) -> Column:
    return F.when(F.size(values) > 0, shown)
