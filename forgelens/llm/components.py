"""Connected components of a table of links, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save

ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v), u > v.

    Large: every neighbour above u is linked to u's least neighbour.  Small: u and
    its lower neighbours are linked to the least of them.  A node of any degree is
    only ever aggregated to one number and joined back, never gathered.
    """
    pairs = edges
    if large:
        pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        joined = pairs.join(least.withColumn("m", F.least("m", "u")), "u").where("v > u")
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        lower = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = lower.union(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b); the component is its least node.

    Each round is written to the shared folder; the number of rounds grows with the
    logarithm of a component's diameter.  No links, no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = save(edges.distinct(), "links")
    for _ in range(ROUNDS):
        edges = save(_star(_star(edges, True), False), "stars")
        # stars: every node hangs on one other, and what it hangs on hangs on nothing
        tops = edges.select(F.col("v").alias("u")).distinct()
        hung = edges.select("u").unionByName(tops).groupBy("u").agg(F.count("*").alias("n"))
        if hung.where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
