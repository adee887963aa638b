"""Connected components of a DataFrame of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    own = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    others = edges.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has links; root is the least node of its component.

    ``links`` has two columns a, b of one comparable type.  Links of a node to
    itself, doubled and reversed links are allowed.  Each round is written to
    the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        edges = cut(_small(_large(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
