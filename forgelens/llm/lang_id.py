"""Language identification by compression with a dictionary per language."""

import math
import re

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the training sample, per language: distinct texts looked at, and bytes
#: of the dictionary made from them.  Of a text above SAMPLE_TEXT bytes a piece of
#: SAMPLE_PIECE characters is taken, from a place that its hash names.
SAMPLE_TEXTS = 600
DICTIONARY_BYTES = 1 << 17
SAMPLE_TEXT = 1 << 14
SAMPLE_PIECE = 1 << 13
LEVEL = 6
BLOCK = 1 << 13  # bytes compressed at once, so that the dictionary stays in reach
MARGIN = 0.005  # least gain over the second language, as a share of its size
_STEPS = 1 << 30
_OTHER = re.compile(r"[\W\d_]+")
_PAD = b"0" * 32  # keeps a short text from being stored as it is, whatever the dictionary


def letters(text: str) -> bytes:
    """Lower-case words with one space around each: what is learned and compressed."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def fit_dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """A raw-content dictionary per language from a bounded sample of texts.

    The sample is chosen by the hash of the text, about SAMPLE_TEXTS distinct texts per
    language, whatever the size of the table and however often a text is repeated; a
    language that gets none so takes the texts of its smallest hashes.  Short texts are
    taken whole, of long ones a piece, so that every labelled language is learned.
    Dictionaries are put together on the executors; the driver holds them, DICTIONARY_BYTES
    a language at most, and two counts per language.  Languages come in descending number
    of rows.  Rows with a null or empty text or without a language are not learned from.
    """
    text = F.col(text_col).cast("string")
    rows = labelled.select(F.col(lang_col).alias("lang"), text.alias("text"))
    rows = rows.where("lang IS NOT NULL").where(F.octet_length("text") > 0)
    h = F.xxhash64("text")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("d")).collect()
    if not found:
        return {}
    counts = {r["lang"]: r["n"] for r in found}
    chosen = F.lit(False)
    slot = F.pmod(h, F.lit(_STEPS))
    for r in found:
        share = math.ceil(_STEPS * SAMPLE_TEXTS / max(r["d"], 1))
        chosen |= (F.col("lang") == r["lang"]) & (slot < min(_STEPS, share))
    made = dict(_dictionaries(_pieces(rows.where(chosen), h)))
    for lang in sorted(counts.keys() - made.keys()):
        least = _pieces(rows.where(F.col("lang") == lang), h).orderBy(F.pmod("h", F.lit(_STEPS)), "h")
        made |= dict(_dictionaries(least.limit(SAMPLE_TEXTS)))
    frequent = sorted(counts, key=lambda lang: (-counts[lang], lang))
    return {lang: made[lang] for lang in frequent if made.get(lang)}


def _pieces(rows: DataFrame, h) -> DataFrame:
    """(lang, h, t): the distinct texts, long ones cut to a piece where they are read."""
    length = F.char_length("text")
    start = (F.pmod(h, F.greatest(length - SAMPLE_PIECE, F.lit(0)) + 1) + 1).cast("int")
    short = (F.octet_length("text") <= SAMPLE_TEXT) | (length <= SAMPLE_PIECE)
    piece = F.when(short, F.col("text")).otherwise(F.substring("text", start, F.lit(SAMPLE_PIECE)))
    return rows.groupBy("lang", h.alias("h")).agg(F.max(piece).alias("t"))


def _dictionaries(sample: DataFrame) -> list[tuple]:
    """(language, dictionary) from the texts of a sample, each made in one task."""

    def build(texts: pd.DataFrame) -> pd.DataFrame:
        data = bytearray()
        for text in texts.sort_values("h")["t"]:
            more = letters(text)
            if len(data) + len(more) <= DICTIONARY_BYTES:
                data += more
        return pd.DataFrame({"lang": texts["lang"].iloc[:1], "dictionary": [bytes(data)]})

    schema = T.StructType([sample.schema["lang"], T.StructField("dictionary", T.BinaryType())])
    return [(r["lang"], bytes(r["dictionary"])) for r in sample.groupBy("lang").applyInPandas(build, schema).collect()]


class Classifier:
    """Compressed sizes under each dictionary; the smallest names the language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.by_lang = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(
                dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            data.precompute_compress(level=LEVEL)
            self.by_lang.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin) of a whole text; ``und`` without a letter."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        data = letters(text)
        blocks = [_PAD + data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(compress(b)) for b in blocks) for compress in self.by_lang]
        best = min(sizes)
        others = sorted(sizes)[1:] or [best + len(data)]
        width = 2 + best / 50  # bytes that make a language e times as likely
        score = 1 / sum(math.exp(min((best - s) / width, 0)) for s in sizes)
        return self.langs[sizes.index(best)], score, (others[0] - best) / others[0]


def identify_languages(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    margin: float = MARGIN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) of every row, from its whole text.

    A text is compressed in blocks with each language's dictionary; the smallest
    total wins, equal totals go to the language with more training rows.  ``margin`` is the gain over the
    second language as a share; below the limit, or without a letter (``und``; null
    and empty texts too), the prediction is rejected.  Repeated rows give repeated
    rows, an empty table none.  With no dictionary every text is ``und``.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType(
        [
            rows.schema[0],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("margin", T.DoubleType()),
        ]
    )

    def predict(batches):
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.classify(text) for text in batch.column(1).to_pylist()]
            langs, scores, margins = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(margins, pa.float64())],
                schema.names,
            )

    rejected = (F.col("lang_pred") == "und") | (F.col("margin") < margin)
    return rows.mapInArrow(predict, schema).withColumn("rejected", rejected)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(True))
