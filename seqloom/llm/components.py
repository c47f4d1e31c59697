"""Connected components of a link table, by alternating large and small stars.

Every round sends each node's smallest neighbour back to its links. A hub that
holds a third of all links is summed up before it is shuffled, and its links are
dealt by (node, salt), so no task holds them all. No link, node or component
is ever brought to the driver; only a row count and a checksum are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, with_least


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = with_least(both, "u", "v", "m", "v")
    return least.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # u is the larger end of its links: itself and all smaller neighbours go to the smallest of these
    least = with_least(edges, "u", "v", "m", "v")
    ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    return least.select(ends).select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that has a link; component is its smallest reachable node.

    edges: two long columns u, v in either order; repeats and self-links are
    allowed and change nothing, rows with a null end are ignored.
    """
    edges = checkpointed(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    state = None
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
