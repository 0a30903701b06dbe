"""Token ids as Parquet files that allow selective reads, and back."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import slices
from .store import save, shuffle_partitions, small_side
from .tokens import encoder

#: Row groups of 16 MiB and pages of 256 KiB: a reader that looks for some documents
#: skips by the page index, one that wants metadata reads no page of ids.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
    "parquet.enable.dictionary": "true",  # ids: at most a vocabulary per row group
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding of what has no dictionary
    "compression": "zstd",
}


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of every document, in ascending order of its id, below ``path``.

    Files hold ranges of ids, so their order and the order of rows inside is the
    order of the documents: nulls first, equal ids by text.  Columns: the id, part
    and part_start (the file's place, and ids before the document in that file),
    n_tokens and the list ``ids``, which ends with ``end_id``; a null or empty text
    is ``end_id`` alone.  An empty table writes no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType(
        [rows.schema[0]]
        + [T.StructField(n, T.LongType()) for n in ("part", "part_start", "n_tokens")]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def encode_sorted(batches):
        encode, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, some in slices(batch.column(1), 1 << 20):
                ids, counts = encode.encode(some)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
                ends = np.cumsum(counts + 1)
                starts = before + ends - counts - 1
                before += int(ends[-1])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), pa.array([part] * len(some), pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(counts + 1, pa.int64()), lists],
                    schema.names,
                )

    ordered = rows.repartitionByRange(
        shuffle_partitions(docs.sparkSession), id_col
    ).sortWithinPartitions(id_col, "_text")
    ordered.mapInArrow(encode_sorted, schema).write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document below ``path``.

    ``start`` is the number of ids of all documents before it.  Totals per file come
    from the metadata columns alone; a selection on the id or a projection without
    ``ids`` reads no more than it names.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written file
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    offsets = small_side(save(totals.select("part", before.alias("before")).coalesce(1), "offsets"))
    return files.join(offsets, "part").select(
        id_col, (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def with_ids_crc32(tokens: DataFrame) -> DataFrame:
    """The columns but ``ids``, and its unsigned crc32 as little-endian 32-bit numbers."""
    keep = [c for c in tokens.columns if c != "ids"]
    schema = T.StructType(
        [tokens.schema[c] for c in keep] + [T.StructField("ids_crc32", T.LongType())]
    )

    def digest(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ends = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], schema.names)

    return tokens.select(*keep, "ids").mapInArrow(digest, schema)
