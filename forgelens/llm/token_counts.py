"""Token counts per document."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; lengths leave Python, ids do not.

    ``tokenizer`` is the path of a file for the tokenizers library, present on every
    executor.  Batches are balanced by characters and long texts are cut at safe
    boundaries.  A null text counts as empty (0 bytes, 0 tokens); a null id stays
    null; repeated rows give repeated rows; an empty table gives none.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType(
        [
            rows.schema[0],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def count(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array(encode.counts(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, n_tokens], [id_col, "n_bytes", "n_tokens"]
            )

    counted = rows.mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
