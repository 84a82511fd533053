"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import materialise, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges``; the component is its smallest node.

    Large-star links each node's larger neighbours to its smallest neighbour, small-star links the
    smaller ones; both keep the components and the number of edges at most, and they end in stars
    around the smallest nodes after about log(n) rounds. Each round is written to the shared folder. More than
    ``most_rounds`` rounds raise an error; there is no half-done result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    nodes = materialise(nodes, "nodes")
    e = materialise(e, "edges")
    last = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialise(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        release(before)
        # Stars around the smallest nodes map to themselves; equal hash sums mean equal edge tables.
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return nodes.join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
