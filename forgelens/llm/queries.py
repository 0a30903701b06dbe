"""Registered queries of the training-data operators over the driver's tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql, warc
from .centroids import cluster_vectors
from .exact_dedup import exact_duplicates
from .fingerprint import fingerprint_with_edits
from .html_text import fit_weights, main_text
from .jaccard import near_duplicates
from .lang_id import fit_dictionaries, held_out, identify_languages
from .mixing import temperature_mix
from .packing import pack_power_of_two
from .store import shared_path
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .token_files import read_token_files, with_ids_crc32, write_token_files
from .vector_codes import compress_vectors

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack_power_of_two(spark, sf_dir) -> DataFrame:
    pieces = pack_power_of_two(_read(spark, sf_dir, "documents"), BYTE_BPE, 1024, 0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_language_id(spark, sf_dir) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.where(~held_out()))
    found = identify_languages(docs, dictionaries)
    return found.withColumn("held_out", held_out())


def op3_suffix_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), 100).drop("spans")


def op4_token_files(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(_read(spark, sf_dir, "documents"), path, WORD_BPE, 2)
    return with_ids_crc32(read_token_files(spark, path))


def op5_warc(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), path)
    page = lambda uri: F.regexp_extract(uri, r"^<urn:x-page:(-?[0-9]+):", 1)
    number = lambda uri: F.when(page(uri) != "", page(uri)).cast("bigint")
    return warc.reassembled(spark, path).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "n_segments",
        "complete",
    )


def op6_scaled_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprint_with_edits(_read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents")).drop("first")


def op9_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), BYTE_BPE, 512)


def op10_temperature_mix(spark, sf_dir) -> DataFrame:
    return temperature_mix(_read(spark, sf_dir, "documents"))


def op11_ptolemaic_clusters(spark, sf_dir) -> DataFrame:
    return cluster_vectors(_read(spark, sf_dir, "embeddings")).drop("checked")


def op12_gnat_codes(spark, sf_dir) -> DataFrame:
    return compress_vectors(_read(spark, sf_dir, "embeddings"))


def op13_html_text(spark, sf_dir) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return main_text(pages, fit_weights(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_pack_power_of_two": op1_pack_power_of_two,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_files": op4_token_files,
    "op5_warc": op5_warc,
    "op6_scaled_fingerprint": op6_scaled_fingerprint,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_counts": op9_token_counts,
    "op10_temperature_mix": op10_temperature_mix,
    "op11_ptolemaic_clusters": op11_ptolemaic_clusters,
    "op12_gnat_codes": op12_gnat_codes,
    "op13_html_text": op13_html_text,
}

#: The others need a tokenizer, a compressor, archives or bytes; the tests compare those
#: with plain versions.
ORACLE_SQL = {
    "op7_exact_dedup": sql.EXACT_DEDUP,
    "op8_ngram_jaccard": sql.NGRAM_JACCARD,
    "op10_temperature_mix": sql.TEMPERATURE_MIX,
    "op11_ptolemaic_clusters": sql.CLUSTERS,
    "op12_gnat_codes": sql.VECTOR_CODES,
}
