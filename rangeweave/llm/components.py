"""Connected components of a table of links, by alternating star operations.

Each round links every node to the smallest node it knows of (first its larger neighbours, then its smaller ones), so
trees flatten into stars in a number of rounds logarithmic in the number of nodes. A hub's links meet in one join key
only by way of a two-sided shuffle join, which adaptive execution splits; minima are pre-aggregated before shuffling.

Each round's links are checkpointed in as many files as they fill with ``ROWS`` links (those of the round before are
counted), not one for each shuffle partition: Hadoop's local file system starts a process for every file it creates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.llm.common import cut

#: Links of a checkpoint's file, about.
ROWS = 10_000


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; ``edges`` has long columns a and b; a root is its group's smallest node.

    Links of a node to itself, repeated links and either direction are all fine; null ends are ignored.
    """
    edges = cut(_ordered(edges))
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        links = _ordered(small)
        edges = cut(links if state is None else links.coalesce(-(-state[0] // ROWS) or 1))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now
