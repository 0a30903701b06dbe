"""The operators as stages: what becomes of the rows of a table of documents.

Rows are told apart by their id and the hash of their text, so tables in which ids
repeat keep the right rows.  While a stage works, a row travels as one struct, so no
column of a table can clash with the names used here.
"""

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import exact_duplicates
from .jaccard import near_duplicates
from .lang_id import fit_dictionaries, held_out, identify_languages
from .mixing import temperature_mix
from .packing import pack_power_of_two

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str | None = None) -> DataFrame:
    """(doc, id, text, sha, rest[, source]): the row, what tells it apart, and its order."""
    text = F.col(text_col).cast("string")
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    rest = [column for name, column in columns.items() if name != text_col]
    source = [F.col(source_col).cast("string").alias("source")] if source_col else []
    return docs.select(
        F.struct(*columns.values()).alias("doc"),
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("sha"),
        # as text: rows with maps and other values that have no order can be ranked too
        (F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")).alias("rest"),
        *source,
    )


def _with(rows: DataFrame, found: DataFrame, *more) -> DataFrame:
    """The rows with what was found for their (k_id, k_sha)."""
    same = rows["id"].eqNullSafe(found["k_id"]) & (rows["sha"] == found["k_sha"])
    for condition in more:
        same &= condition
    return rows.join(found, same)


def _numbered(joined: DataFrame, *keys: str) -> DataFrame:
    """Numbers rows that the keys do not tell apart from 1, in the order of the rest as JSON."""
    return joined.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("rest")))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose language is identified; rows with one id and text are judged alike.

    With no labelled text to learn from, the rows with a letter stay.
    """
    dictionaries = fit_dictionaries(docs.where(~held_out(id_col)), text_col)
    if not dictionaries:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    rows = _rows(docs, id_col, text_col)
    key = rows.select(F.struct("id", "sha").alias("key"), "text")
    good = identify_languages(key, dictionaries, id_col="key").where("NOT rejected")
    good = good.select(F.col("key.id").alias("k_id"), F.col("key.sha").alias("k_sha")).distinct()
    return _with(rows, good).select("doc.*")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, that with the largest id."""
    rows = _rows(docs, id_col, text_col)
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    kept = kept.select(F.col(id_col).alias("k_id"), F.col("text_sha256").alias("k_sha"))
    return _numbered(_with(rows, kept), "id", "sha").where("nth = 1").select("doc.*")


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate component, that with the smallest id."""
    rows = _rows(docs, id_col, text_col)
    first = near_duplicates(rows.select("id", "text", "sha"), "id", "text", carry=("sha",)).where("first")
    first = first.groupBy(F.col("id").alias("k_id"), F.col("sha").alias("k_sha")).agg(F.count("*").alias("stay"))
    return _numbered(_with(rows, first), "id", "sha").where("nth <= stay").select("doc.*")


def read_in_mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """A row for every reading of a row in the mixture of sources.

    Readings of repeated rows, which the mixture cannot tell apart, are dealt out
    evenly among them.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    mixed = temperature_mix(rows.select("id", "sha", "source", "text"), id_cols=("id", "sha"))
    reads = mixed.groupBy(
        F.col("id").alias("k_id"), F.col("sha").alias("k_sha"), F.col("source").alias("k_source")
    ).agg(F.count("*").alias("reads"))
    joined = _with(rows, reads, rows["source"].eqNullSafe(reads["k_source"]))
    keys = ["id", "sha", "source"]
    joined = _numbered(joined, *keys).withColumn("alike", F.count("*").over(Window.partitionBy(*keys)))
    times = F.expr("reads div alike") + (F.col("nth") <= F.expr("reads % alike")).cast("bigint")
    again = F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("again")
    return joined.select("doc", again).select("doc.*")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all rows, their ids as a checksum."""
    pieces = pack_power_of_two(docs, BYTE_BPE, 1024, 0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
