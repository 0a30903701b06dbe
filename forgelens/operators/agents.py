"""Agent event logs: transcripts, timelines and the tools called."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registries as R

UNKNOWN = "unknown"
PREVIEW_MIN, PREVIEW_CUT = 20, 300


def author_label(author, labels=tuple(R.AGENT_LABELS)):
    """display label of a known agent, looked up by its exact name, else that name."""
    label = F.lit(None)
    for name, shown in labels:
        label = F.when(author == name, shown).otherwise(label)
    return F.coalesce(label, author)


def with_author(events: DataFrame) -> DataFrame:
    known = F.when(F.col("author") != "", F.col("author"))
    return events.withColumn("author", F.coalesce(known, F.lit(UNKNOWN)))


def session_transcript(events: DataFrame) -> DataFrame:
    """Session, seq, text of the final responses; in the order of ``seq`` they are
    the transcript.  A projection, however long a session is."""
    return events.where(F.col("is_final") & (F.col("text") != "")).select("session", "seq", "text")


def joined_transcript(events: DataFrame) -> DataFrame:
    """The lines of each session joined by line feeds, for sessions known to be short:
    a session becomes one value."""
    in_order = F.sort_array(F.collect_list(F.struct("seq", "text")))
    texts = session_transcript(events).groupBy("session").agg(in_order.alias("_texts"))
    return texts.select("session", F.array_join("_texts.text", "\n").alias("text"))


def agent_timeline(events: DataFrame) -> DataFrame:
    """Q12: per session and author the event count, first event and text preview.

    Numbers are aggregated by hash; the one event to preview is then fetched by its
    ``seq``, which is unique in a session.  Display order is ``first_seq``.
    """
    authored = with_author(events)
    telling = F.when(F.length("text") > PREVIEW_MIN, F.col("seq"))
    numbers = authored.groupBy("session", "author").agg(
        F.min("seq").alias("first_seq"),
        F.count("*").alias("event_count"),
        F.min(telling).alias("_seq"),
    )
    shown = authored.where(F.length("text") > PREVIEW_MIN).select(
        "session",
        "author",
        F.col("seq").alias("_seq"),
        F.substring("text", 1, PREVIEW_CUT).alias("text_preview"),
    )
    return (
        numbers.join(shown, ["session", "author", "_seq"], "left")
        .drop("_seq")
        .withColumn("label", author_label(F.col("author")))
    )


def agent_tools(events: DataFrame) -> DataFrame:
    """Q12: the distinct tools of a session and author in first-seen order.

    Calls are reduced to one row per tool name before they are listed, so a
    list is as long as the agent's tool set.
    """
    authored = with_author(events)
    per_tool = authored.groupBy("session", "author", "tool").agg(
        F.min("seq").alias("seq"), F.count("*").alias("n")
    )
    named = F.when(F.col("tool").isNotNull(), F.struct("seq", "tool"))
    return (
        per_tool.groupBy("session", "author")
        .agg(F.sort_array(F.collect_list(named)).alias("_tools"), F.sum("n").alias("event_count"))
        .select(
            "session", "author", F.array_join("_tools.tool", ",").alias("tools"), "event_count"
        )
    )
