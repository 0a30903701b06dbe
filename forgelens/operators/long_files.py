"""Line rules over files that come in pieces: secrets and dangerous APIs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.materialize import materialize
from . import scans

LINE_KINDS = (scans.SECRET, scans.DANGEROUS)
_FILE = ("repo", "path")


def scan_pieces(pieces: DataFrame, kinds=LINE_KINDS, strict_mask: bool = False) -> DataFrame:
    """The hits that ``scan_files`` finds in whole files, from pieces of them.

    ``pieces(repo, path, block, part, content)`` as ``read_long_files`` gives them: a piece
    ends with a line, and (block, part) is its place in the file.  Kinds are those of
    line rules; a dangerous rule keeps its first line of the file.  Line numbers are
    sums over earlier pieces: of blocks in the file, then of parts in the block, so no
    window holds more than the blocks of a file or the parts of a block.

    Content is read once; hits and line counts of pieces are written before they are
    numbered, so that both come from the same splits.
    """
    if not set(kinds) <= set(LINE_KINDS):
        raise ValueError(f"only {LINE_KINDS} are rules of single lines")
    found = scans.scan_files(
        pieces, [*kinds, scans.LINES], strict_mask=strict_mask, keep=("block", "part")
    )
    found = materialize(found, "piece-hits")
    counts = found.where(F.col("kind") == scans.LINES)
    starts = _starts(counts.select(*_FILE, "block", "part", F.col("lineno").alias("n")))
    hits = found.where(F.col("kind") != scans.LINES)
    placed = hits.join(starts, [*_FILE, "block", "part"]).select(
        *_FILE, "kind", "key", "severity", (F.col("start") + F.col("lineno")).alias("lineno"), "text"
    )
    once = placed.where(F.col("kind") == scans.DANGEROUS).groupBy(*_FILE, "kind", "key").agg(
        F.min(F.struct("lineno", "severity", "text")).alias("first")
    )
    once = once.select(*_FILE, "kind", "key", "first.severity", "first.lineno", "first.text")
    return placed.where(F.col("kind") != scans.DANGEROUS).unionByName(once)


def _starts(counts: DataFrame) -> DataFrame:
    """(repo, path, block, part, start): the lines of the file before each piece."""
    block = [*_FILE, "block"]
    in_file = Window.partitionBy(*_FILE).orderBy("block")
    in_block = Window.partitionBy(*block).orderBy("part")
    blocks = counts.groupBy(*block).agg(F.sum("n").alias("lines"))
    blocks = blocks.select(*block, (F.sum("lines").over(in_file) - F.col("lines")).alias("before"))
    parts = counts.withColumn("inside", F.sum("n").over(in_block) - F.col("n"))
    return parts.join(blocks, block).select(*block, "part", (F.col("before") + F.col("inside")).alias("start"))
