"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.tables import written


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """``edges`` (a, b: bigint) to one row ``node, component`` for each node; the component is its smallest node.

    Loops, repeated and null edges are left out; no edges give no rows. Each round
    is a minimum per node (combined before the shuffle) and a join that Spark can split
    where a node has very many edges, and is written to the shared folder. Nothing is
    gathered on the driver but a count and a checksum.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, name)
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        after = _state(now)
        if after == before:
            break
        before = after
    root = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return root.unionByName(root.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
