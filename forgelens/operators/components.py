"""Connected components of links between whole numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize

ROUNDS = 50  # far above what any graph needs: rounds grow with the logarithm of a diameter


def _hang_on_least(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the node's least neighbour, or on the node.

    Nodes are aggregated to one number each and joined back, so that a node with very
    many links is never gathered in one place.
    """
    both = links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    above = both.where("other > node").join(least, "node")
    return above.select(F.col("other").alias("high"), F.least("node", "least").alias("low")).distinct()


def _pull_up(links: DataFrame) -> DataFrame:
    """A node and all its lower neighbours are hung on the least of these."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    others = links.join(least, "high").where("low <> least")
    moved = others.select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``, the component being its least node.

    The links become stars around the least nodes, in rounds that are each written to
    the shared folder.  No links, no rows; links of a node with itself are ignored.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    stars = materialize(ordered.distinct(), "links")
    for _ in range(ROUNDS):
        stars = materialize(_pull_up(_hang_on_least(stars)), "stars")
        # stars: every node hangs on one other, and what it hangs on hangs on nothing
        tops = stars.select(F.col("low").alias("high"), F.lit(1).alias("top")).distinct()
        state = (
            stars.select("high", F.lit(0).alias("top")).union(tops).groupBy("high")
            .agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        )
        if not state:
            break
    else:
        raise RuntimeError("components did not settle")
    hanging = stars.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return hanging.union(stars.select("low", "low").distinct())
