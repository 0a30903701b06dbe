"""Document fingerprints: threshold-scaled sketches of byte shingles."""

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import shuffle_partitions

SHINGLE = 16  # bytes, a power of two
SCALE = 4  # one shingle hash in so many is kept
LEAST = 8  # the smallest hashes, kept whatever they are, so that every text has some
_BASE = 0x9E3779B97F4A7C15
_LEAST = -(1 << 63)


def shingle_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of all shingles, in order; a shorter text is one shingle."""
    if len(data) < SHINGLE:
        digest = hashlib.blake2b(data, digest_size=8).digest()
        return np.frombuffer(digest, np.uint64)[: 1 if data else 0]
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    step, base = 1, _BASE
    while step < SHINGLE:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _kept(h: np.ndarray, scale: int) -> np.ndarray:
    """Of ascending distinct hashes those below 2^64 / scale, and the LEAST smallest."""
    n = int(np.searchsorted(h, np.uint64((1 << 64) // scale - 1), side="right"))
    return h[: max(n, LEAST)]


def sketch(data: bytes, scale: int = SCALE) -> np.ndarray:
    """All distinct shingle hashes below 2^64 / scale, and the smallest few in any case, ascending.

    Whether a hash below the bound is kept depends on nothing but the hash, and the
    smallest of a union are among the smallest of its parts, so :func:`merge` gives the
    sketch of a union and sets of very unequal size can be compared.
    """
    return _kept(np.unique(shingle_hashes(data)), scale)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of two sets of shingles, from theirs."""
    return _kept(np.union1d(a, b), scale)


def _reach(h: np.ndarray, scale: int) -> int:
    """Up to which hash a sketch holds all that its text has."""
    if len(h) < LEAST:
        return (1 << 64) - 1
    return max((1 << 64) // scale - 1, int(h[-1]))


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float | None:
    """Share of a's shingles that b has, from the hashes that both sketches would hold;
    None if ``a`` has none of these."""
    both = np.uint64(min(_reach(a, scale), _reach(b, scale)))
    a = a[: np.searchsorted(a, both, side="right")]
    if not len(a):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def to_text(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def _likeness(a, b, same: bool, scale: int) -> float:
    return 1.0 if same else containment(a, b, scale) or 0.0


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE
) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next).  Rows are taken in descending id (equal ids by descending text, nulls
    last; a null text counts as empty); the next of the last is the first.  A
    fingerprint lists the sketch in base64.  Likeness is the estimated containment of
    the document's shingles in the other's, from the two sketches; 1 for equal texts, and
    0 where an empty text, which alone has an empty sketch, is compared with another.  An
    empty table gives no rows.

    Texts are shuffled once, to ranges of ids.  The first row of each range is also
    sent to the range that precedes it, where the last row needs it; only these first
    ids, one per partition, pass the driver.  Ids must be whole numbers.
    """
    spark = docs.sparkSession
    number = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST))
    ids = docs.select(number.alias("_n"))
    parts = shuffle_partitions(spark)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = ids.agg(F.percentile_approx("_n", shares, 10000).alias("b")).first()["b"]
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("bigint")
    def part_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(), side="left"))

    heads = ids.groupBy(part_of("_n").alias("p")).agg(F.max("_n").alias("head")).collect()
    heads = sorted((r["p"], r["head"]) for r in heads)
    head_ids = np.array([h for _, h in heads], np.int64)
    wanted_by = np.array([p for p, _ in heads[1:] + heads[:1]], np.int64)

    @F.pandas_udf("array<bigint>")
    def also_to(values: pd.Series) -> pd.Series:
        at = np.searchsorted(head_ids, values.to_numpy()).clip(max=max(len(head_ids) - 1, 0))
        found = head_ids[at] == values.to_numpy() if len(head_ids) else np.zeros(len(values), bool)
        return pd.Series([[int(wanted_by[i])] if f else [] for i, f in zip(at, found)], dtype=object)

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    own = F.array(F.struct(part_of("_n").alias("p"), F.lit(False).alias("peek")))
    copies = F.transform(
        also_to("_n"), lambda p: F.struct(p.alias("p"), F.lit(True).alias("peek"))
    )
    placed = (
        docs.select(
            F.col(id_col).alias("_id"),
            number.alias("_n"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
        )
        .select("_id", "_n", "_text", F.explode(F.concat(own, copies)).alias("_to"))
        .repartitionById(max(len(bounds) + 1, 1), F.col("_to.p").cast("int"))
        .sortWithinPartitions(F.col("_to.peek"), F.desc("_n"), F.desc("_text"))
        .select("_id", "_text", F.col("_to.peek").alias("_peek"))
    )

    def one(row, following) -> tuple:
        key, text, mine = row
        next_text, next_sketch = following
        edited = edited_text(text, next_text)
        data = edited.encode("utf-8", "surrogatepass")
        changed = sketch(data, scale)
        return (
            key, len(text), hashlib.sha256(data).hexdigest(), to_text(mine), to_text(changed),
            _likeness(mine, changed, text == edited, scale), _likeness(mine, next_sketch, text == next_text, scale),
        )

    def walk(batches):
        waiting, ended = None, False
        for batch in batches:
            out = []
            for key, text, peek in zip(*(c.to_pylist() for c in batch.columns)):
                if ended:
                    continue
                mine = sketch(text.encode("utf-8", "surrogatepass"), scale)
                if waiting is not None:
                    out.append(one(waiting, (text, mine)))
                waiting, ended = (key, text, mine), peek
            arrow = pa.schema(
                [pa.field(id_col, batch.schema.field(0).type), ("n_chars", pa.int64())]
                + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
                + [(n, pa.float64()) for n in ("near_edited", "near_next")]
            )
            columns = list(zip(*out)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return placed.mapInArrow(walk, schema)
