"""Exact duplicates by composable polynomial fingerprints, compared chunk by chunk."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import save

PRIME = (1 << 31) - 1
BASES = (1_000_003_019, 1_357_924_681, 2_017_263_943)
#: 2^8 * 2^31 * 2^12 < 2^53: a chunk's sum is exact in a double
CHUNK = 1 << 12
COMPARED = 1 << 14  # bytes of a text that are compared at once
_KEY = ["fp_a", "fp_b", "n_bytes"]


def _powers(base: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % PRIME)
    return np.array(out, np.int64)


_IN_CHUNK = np.stack([_powers(b, CHUNK)[::-1] for b in BASES], axis=1).astype(np.float64)


def chunk_fingerprints(data: bytes) -> np.ndarray:
    """Polynomial hashes of consecutive chunks, one row each, a column per base.

    The first chunk is the short one; zeros in front of it do not count.
    """
    short = -len(data) % CHUNK
    padded = np.zeros(short + len(data), np.uint8)
    padded[short:] = np.frombuffer(data, np.uint8)
    rows = padded.reshape(-1, CHUNK)
    parts = [rows[i : i + 512].astype(np.float64) @ _IN_CHUNK for i in range(0, len(rows), 512)]
    sums = np.concatenate(parts) if parts else np.zeros((0, len(BASES)))
    return sums.astype(np.int64) % PRIME


def combine(left, right, right_bytes: int) -> tuple:
    """The fingerprint of two byte strings, one after the other, from theirs."""
    return tuple(
        (int(x) * pow(b, right_bytes, PRIME) + int(y)) % PRIME for x, y, b in zip(left, right, BASES)
    )


def fingerprint(data: bytes) -> tuple:
    """The fingerprint of a whole byte string from those of its chunks."""
    chunks = chunk_fingerprints(data)
    total: tuple = (0,) * len(BASES)
    for row in chunks:
        total = combine(total, row, CHUNK)
    return total


def _key(data: bytes) -> tuple[int, int, int]:
    a, b, c = fingerprint(data)
    return a << 31 | b, c, len(data)


def _fingerprints(rows: DataFrame, id_col: str) -> DataFrame:
    schema = T.StructType(
        [rows.schema[0]]
        + [T.StructField(n, T.LongType()) for n in _KEY]
        + [T.StructField("text_sha256", T.StringType())]
    )

    def each(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            keys = np.array([_key(t) for t in texts], np.int64).reshape(-1, 3)
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(keys[:, i]) for i in range(3)), pa.array(shas)],
                schema.names,
            )

    return rows.mapInArrow(each, schema)


def _mismatched(rows: DataFrame) -> DataFrame:
    """Fingerprints under which two different texts were found."""
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in _KEY]
        + [T.StructField("chunk_no", T.LongType()), T.StructField("chunk", T.BinaryType())]
    )

    def chunks(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for text in batch.column(1).to_pylist():
                key = _key(text or b"")
                for at in range(0, len(text or b""), COMPARED):
                    piece = text[at : at + COMPARED]
                    for column, value in zip(out, (*key, at // COMPARED, piece)):
                        column.append(value)
                    size += len(piece)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays(arrays(out), schema.names)
                        out, size = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays(arrays(out), schema.names)

    def arrays(columns):
        return [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())]

    # by one number, so that a large group of copies is summed up where it is read
    slot = F.xxhash64(*_KEY, "chunk_no")
    key = F.struct(*_KEY)
    seen = (
        rows.mapInArrow(chunks, schema)
        .groupBy(slot.alias("slot"))
        .agg(
            F.min("chunk").alias("least"),
            F.max("chunk").alias("most"),
            F.min(key).alias("a"),
            F.max(key).alias("b"),
        )
    )
    return (
        seen.where("least <> most")
        .select(F.explode(F.array("a", "b")).alias("k"))
        .select(*[F.col(f"k.{n}").alias(n) for n in _KEY])
        .distinct()
        .withColumn("mismatch", F.lit(True))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal
    texts the row with the largest id stays (a null id only if all are null); of
    repeated rows, equal in id and text, one stays.  An empty table gives no rows.

    The fingerprint of a text is a polynomial in three bases, put together from its
    chunks by :func:`combine`; with the length it names a group.  The texts of groups
    above one row are then compared chunk by chunk: a chunk number of a group has one
    least and one greatest value, whatever the number of copies, and a group where
    they differ is divided by the hash of the whole text.  The first pass is written
    to the shared folder as one narrow row per document.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    prints = save(
        _fingerprints(rows, id_col).withColumn("_row", F.monotonically_increasing_id()), "prints"
    )
    several = prints.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    suspects = (
        prints.select(F.col(id_col).alias("_id"), *_KEY)
        .join(several, _KEY, "left_semi")
        .select("_id")
        .distinct()
    )
    texts = rows.join(suspects, rows[id_col].eqNullSafe(suspects["_id"]), "left_semi")
    bad = _mismatched(texts)
    classed = prints.join(bad, _KEY, "left").select(
        id_col,
        "_row",
        "text_sha256",
        *_KEY,
        F.when(F.col("mismatch"), F.col("text_sha256")).otherwise("").alias("_class"),
    )
    classed = save(classed, "classed")
    last = F.max(F.struct(F.col(id_col).alias("id"), "_row"))
    groups = classed.groupBy(*_KEY, "_class").agg(last.alias("last"), F.count("*").alias("group_size"))
    # written, so that the rows of a large group can be split among the tasks of the join
    groups = save(groups.where("group_size > 1"), "groups")
    joined = classed.join(groups, [*_KEY, "_class"], "left")
    alone = F.col("last").isNull()
    return joined.select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_row") == F.col("last._row"))).alias("kept"),
        "text_sha256",
    )
