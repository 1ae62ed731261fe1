"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is two aggregations and two joins on node ids; no step needs a node's links together, and the links of hubs
are dealt over many tasks. Links, labels and components never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.frames import dealt_join, stored


def components(links: DataFrame, steps: int = 50) -> DataFrame:
    """(node, root): root is the smallest node reachable from node by links (a, b). Nodes without links have no row.

    Self-links and nulls are ignored; repeated links and either direction are fine. Raises if `steps` do not suffice,
    which needs more than 2^25 links in a chain.
    """
    pairs = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(steps):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: each larger neighbour of a node is linked to the smallest of the node and its neighbours.
        large = stored(dealt_join(both, least, "u", F.col("v")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # Small star: each node with its smaller neighbours; after the large step every link runs from a node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = dealt_join(large, low, "a", F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        pairs = stored(small)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"no fixed point after {steps} steps")
