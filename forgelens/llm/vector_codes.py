"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

The entries of a codebook stand in a GNAT, a tree of split points.  A split point keeps the
range of its distances to the entries below every split point beside it; a subtree whose
range lies beyond what the best entry so far allows is left out as a whole.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .centroids import choose_pivots, distances, squared
from .store import save, small_side
from .vectors import Sums, floors_of_means, matrix, usable, whole

ARITY = 8
LEAF = 12  # entries that are compared one by one
SLACK = 2.0**-40


class Gnat:
    """A tree over numbered entries; equal entries stand in one subtree."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None):
        self.entries = entries
        self.numbers = np.arange(len(entries)) if numbers is None else numbers
        self.below: list[Gnat] = []
        if len(entries) <= LEAF:
            return
        self.splits = choose_pivots(entries, ARITY)
        if len(self.splits) < 2:
            return
        between = distances(entries, self.splits)
        own = between.argmin(axis=1)
        shape = (len(self.splits), len(self.splits))
        self.lowest, self.highest = np.empty(shape), np.empty(shape)
        for j in range(len(self.splits)):
            members = own == j
            self.lowest[:, j] = between[members].min(axis=0) * (1 - SLACK)
            self.highest[:, j] = between[members].max(axis=0) * (1 + SLACK)
            self.below.append(Gnat(entries[members], self.numbers[members]))

    def search(self, rows: np.ndarray, at: np.ndarray, best: np.ndarray, label: np.ndarray) -> int:
        """Takes entries of this tree into the best of the rows ``at``; how many it compared.

        A split point is an entry of its own subtree, so its distance bounds the best one
        before that subtree is entered.  A subtree is left out only if it lies strictly
        beyond, with the distances rounded in its favour; entries are compared in whole
        numbers, and of equal distances the smaller number is taken.
        """
        if not len(at):
            return 0
        if not self.below:
            for number, entry in zip(self.numbers.tolist(), self.entries):
                found = squared(rows[at], entry)
                closer = (found < best[at]) | ((found == best[at]) & (number < label[at]))
                taken = at[closer]
                best[taken], label[taken] = found[closer], number
            return len(at) * len(self.numbers)
        exact = np.stack([squared(rows[at], split) for split in self.splits], axis=1)
        to_splits = np.sqrt(exact.astype(np.float64))
        reach = np.minimum(exact.min(axis=1), best[at])
        compared = exact.size
        # nearest subtrees first: they are the ones that shorten the reach
        for j in np.argsort(to_splits.sum(axis=0)):
            radius = np.sqrt(np.minimum(reach, best[at]).astype(np.float64)) * (1 + SLACK)
            low = to_splits * (1 - SLACK) - radius[:, None]
            high = to_splits * (1 + SLACK) + radius[:, None]
            alive = ((low <= self.highest[:, j]) & (high >= self.lowest[:, j])).all(axis=1)
            compared += self.below[j].search(rows, at[alive], best, label)
        return compared

    def nearest(self, rows: np.ndarray):
        """(number, squared distance) of the nearest entry of each row, and the comparisons made."""
        best = np.full(len(rows), np.iinfo(np.int64).max)
        label = np.full(len(rows), len(self.entries), np.int64)
        compared = self.search(rows, np.arange(len(rows)), best, label)
        return label, best, compared


def compress_vectors(
    rows: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector.

    Null vectors and those with a null or non-finite component are dropped; each component
    x of the others counts as floor(scale * x).  Vectors are cut into ``parts`` equal
    pieces.  All have the length of the first that can be cut so, by id; vectors of other
    lengths are dropped too.  The codebook of a part position starts as that part of the
    ``entries`` smallest ids (equal ids: the smaller vector first; null ids last); fewer
    vectors make fewer entries.  Each round assigns every part to its nearest entry, ties
    to the smaller number, and moves entries that have parts to the exact floor of their
    mean; then the parts are assigned again.

    ``code`` has two hex digits per part, so ``entries`` is at most 256; ``error`` is the
    sum of squared distances, ``label_error`` the sum over all rows of that label, null
    labels together (null beyond a long).  Components beyond 2^27 either way count as
    that.  Repeated rows count as often as they stand there; without vectors no rows.

    The whole-number vectors are written once; a round sends one sum per entry, component
    and task, and the driver holds the codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    vector = F.col(vector_col)
    kept = rows.where(usable(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), whole(vector, scale).alias("_v")
    )
    order = [F.col("_id").asc_nulls_last(), F.col("_v")]
    dims = len((kept.orderBy(*order).select("_v").first() or ([0] * parts,))[0])
    width = dims // parts
    kept = save(kept.where(F.size("_v") == dims), "whole-vectors")
    first = kept.orderBy(*order).limit(entries).select("_v").collect()
    # one row per slot: part after part, entry after entry
    books = np.array([r["_v"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    count = books.shape[1]
    books = books.reshape(-1, width)

    def trees(books):
        return [Gnat(book) for book in books.reshape(parts, count, width)] if count else []

    def pieces(batch):
        return matrix(batch.column("_v"), dims).astype(np.int64).reshape(-1, parts, width)

    for _ in range(rounds if count else 0):

        def summed(batches, books=books):
            made, sums = trees(books), Sums(parts * count, width)
            for batch in batches:
                points = pieces(batch)
                for p, tree in enumerate(made):
                    own = np.ascontiguousarray(points[:, p])
                    sums.add(p * count + tree.nearest(own)[0], own)
            yield sums.batch()

        books = floors_of_means(kept.select("_v").mapInArrow(summed, Sums.SCHEMA), books)

    final = books
    numbers = ",".join(map(str, final.reshape(-1).tolist()))
    sha = hashlib.sha256(numbers.encode()).hexdigest()

    def coded(batches):
        made = trees(final)
        for batch in batches:
            points = pieces(batch)
            codes = np.zeros((len(points), parts), np.uint8)
            error = np.zeros(len(points), np.int64)
            for p, tree in enumerate(made):
                label, best, _ = tree.nearest(np.ascontiguousarray(points[:, p]))
                codes[:, p] = label
                error += best
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array(text, pa.string()), pa.array(error)],
                ["_id", "_label", "code", "error"],
            )

    schema = T.StructType(
        [*kept.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )
    found = save(kept.mapInArrow(coded, schema), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = found.groupBy(F.col("_label").alias("_of")).agg(total.alias("total"))
    # written, so that the rows of a label that many share can be split among the tasks of a join
    sums = save(sums.select("_of", F.expr("try_cast(total AS bigint)").alias("label_error")), "label-errors")
    joined = found.join(small_side(sums), F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")
    )
