"""Whole-number vectors and their sums, shared by the vector operators."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond it, either way, count as it: squared distances of up to 64 such
#: components, and sums of 2^36 of them, fit in a long.
LARGEST = 1 << 27


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; ``scale`` is a power of two, so that this is exact."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        return F.floor(F.greatest(F.least(scaled, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, odd)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of lists of ``dims`` numbers each, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


class Sums:
    """Numbers of rows and componentwise sums per slot, for one task."""

    SCHEMA = "slot int, n bigint, sums array<bigint>"

    def __init__(self, slots: int, dims: int):
        self.n = np.zeros(slots, np.int64)
        self.sums = np.zeros((slots, dims), np.int64)

    def add(self, slots: np.ndarray, rows: np.ndarray):
        self.n += np.bincount(slots, minlength=len(self.n))
        np.add.at(self.sums, slots, rows)

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        sums = pa.array([s.tolist() for s in self.sums[used]], pa.list_(pa.int64()))
        columns = [pa.array(used, pa.int32()), pa.array(self.n[used]), sums]
        return pa.RecordBatch.from_arrays(columns, ["slot", "n", "sums"])


def floors_of_means(partial: DataFrame, before: np.ndarray) -> np.ndarray:
    """The slots' exact floor(sum / count), from the sums of all tasks; slots without rows as before.

    The driver gets one number per slot and component, whatever the number of vectors.
    """
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = (
        partial.select("slot", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("slot", "place")
        .agg(wide("n").alias("n"), wide("part").alias("total"))
        .collect()
    )
    after = before.copy()
    for row in rows:
        after[row["slot"], row["place"]] = int(row["total"]) // int(row["n"])
    return after


def long_or_null(total) -> int | None:
    """A sum of longs as a long; None beyond its range."""
    return int(total) if total is not None and abs(int(total)) < 1 << 63 else None
