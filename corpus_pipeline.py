"""A training corpus from raw documents, in five stages of the llm operators.

Each stage reads all that the one before kept.  All but the last return the columns of
their input.  A null text never stops a stage; each docstring says what becomes of it.
"""

from pyspark.sql import DataFrame, SparkSession

from forgelens.llm import stages
from forgelens.llm.store import save


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject (operator 2).

    Rejected: no letter in the text (null and empty ones too), or a margin below the
    operator's.  Learns from the stage's own labelled documents, its training share
    of them; if none has a label, every text without a letter goes and the rest stay.
    """
    return stages.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, that with the largest doc_id (operator 7).

    Null and empty texts are equal; of repeated rows one stays.
    """
    return stages.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id (operator 8).

    Texts without words are in no group and stay.
    """
    return stages.keep_one_of_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of a mixture of sources, one row each (operator 10).

    Documents of sources that weigh less than they hold are read in part, others
    perhaps several times.  The operator's own entropy target and repetition limit.
    """
    return stages.read_in_mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as padding-free sequences of power-of-two lengths (operator 1).

    A document that the mixture reads twice is packed twice.  Returns doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id and offset.
    """
    return stages.packed(docs)


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression and tokenization are not expressible in SQL; the tests compare each
#: stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
