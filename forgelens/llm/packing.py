"""Packing documents into training sequences by power-of-two decomposition."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import save, small_batches, small_side
from .tokens import encoder


def binary_pieces(n: int, longest: int) -> list[int]:
    """Piece lengths of n tokens: full pieces, then the bits of the rest, largest first."""
    full, rest = divmod(n, longest)
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [longest] * full + bits


def pack_power_of_two(
    docs: DataFrame,
    tokenizer: str,
    longest: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document as pieces whose lengths are powers of two up to ``longest``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Each piece is a sequence of its own: no sequence crosses documents and none is
    padded, and sequences of one length (the bucket) are numbered without gaps, so
    a bucket can be read as a block of equal rows.  Numbers ascend with the bucket.

    Returns (id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` is
    the piece as little-endian unsigned 32-bit numbers.  Repeated rows are packed as
    documents of their own; a null id stays null; an empty table gives no rows.
    The pieces are written once to the shared folder; only counts per task and
    bucket, a table as small as the number of tasks, are summed for numbering, and
    broadcast if they are few enough.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType(
        [rows.schema[0]]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "part", "ordinal")]
    )

    def cut(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for at, some in slices(batch.column(1), 1 << 20):
                ids, counts = encode.encode(some)
                yield pieces(batch.column(0).slice(at, len(some)), ids, counts, part, seen)

    def pieces(keys, ids, counts, part, seen):
        ends = np.cumsum(counts)
        flat = np.insert(ids, ends, end_id).astype("<u4")  # the end id after each document
        raw = flat.tobytes()
        owner, start, length, blobs, total, ordinal = [], [], [], [], [], []
        at = 0
        for i, n in enumerate((counts + 1).tolist()):
            begin = 0
            for size in binary_pieces(n, longest):
                owner.append(i)
                start.append(begin)
                length.append(size)
                total.append(n)
                blobs.append(raw[4 * at : 4 * (at + size)])
                ordinal.append(seen.get(size, 0))
                seen[size] = ordinal[-1] + 1
                begin += size
                at += size
        long = lambda values: pa.array(values, pa.int64())
        return pa.RecordBatch.from_arrays(
            [keys.take(long(owner)), long(start), long(length), pa.array(blobs, pa.binary()),
             long(total), long([part] * len(owner)), long(ordinal)],
            schema.names,
        )

    with small_batches(docs.sparkSession):
        cut_up = save(rows.mapInArrow(cut, schema), "packed", compression="zstd")
    per_task = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    in_bucket = Window.partitionBy("length").orderBy("part")
    first = F.sum("n").over(in_bucket) - F.col("n")
    buckets = per_task.groupBy("length").agg(F.sum("n").alias("n"))
    # one row per bucket, at most log2(longest) + 1
    base = F.sum("n").over(Window.orderBy("length")) - F.col("n")
    bases = buckets.select("length", base.alias("base"))
    numbers = (
        per_task.withColumn("first", first)
        .join(bases, "length")
        .select("length", "part", (F.col("first") + F.col("base")).alias("first"))
    )
    numbers = small_side(save(numbers.coalesce(1), "packed-numbers"))
    return cut_up.join(numbers, ["length", "part"]).select(
        id_col,
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("first") + F.col("ordinal")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )


def slices(texts: pa.Array, most: int):
    """(first row, texts) of consecutive rows of about ``most`` bytes; only these become strings at once."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and size + n > most:
            yield start, texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, texts.slice(start).to_pylist()
