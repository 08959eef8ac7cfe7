"""Connected components of a link table by alternating large-star and small-star steps.

Each round rewires every node towards the least node it sees; the link table becomes a set
of stars whose centres are the component minima. Rounds grow with the logarithm of a
component's diameter. Every round is a written table in the shared folder, so
lineage stays short and a lost executor costs one round at most. Nothing but the count and a checksum of the
links reaches the driver.

Hot nodes: a step needs only the minimum over a node's neighbours (a pre-aggregated group-by), and a join
of the neighbours with that minimum, whose sides are plain written tables that Spark may split when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is its component's least node.
    Self-links and repeats are harmless; no links give no rows."""
    current = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        current = small_star(large_star(current))
    # every link now leads from a node to its component's least node
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    links = written(links.filter("u <> v").distinct(), "large")
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return written(tied.unionByName(own).filter("u <> v").distinct(), "stars")
