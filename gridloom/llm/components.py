"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def components(edges: DataFrame, folder: str, sizes: list[int] | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long, not null); root is the least node of its component.

    Each round every node points to its least neighbour below it, pointers are
    followed to their ends, and both ends of an edge are replaced by those;
    loops and repeats go.  At least half of the nodes that still have an edge
    vanish in a round, and the edges with them.  Edges from a node to itself
    count as no edge.  Rounds are written to ``folder``; ``sizes`` gets the
    number of edges of each.
    """
    spark = edges.sparkSession
    rows = lambda high, low: (F.greatest(high, low).alias("high"), F.least(high, low).alias("low"))
    now = stored(edges.where("a <> b").select(*rows("a", "b")).distinct(), f"{folder}/edges-0")
    labels, k = None, 0
    while n := now.count():
        if sizes is not None:
            sizes.append(n)
        up = stored(now.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), f"{folder}/up-{k}-0")
        j = 0
        while True:  # a node whose pointer leads to a node that points on points there
            beyond = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = up.join(beyond, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
            j += 1
            jumped = stored(jumped, f"{folder}/up-{k}-{j}")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            ends = now.select(F.col("low").alias("node")).distinct().join(up, "node", "left_anti").select("node", F.col("node").alias("root"))
            labels = up.unionByName(ends)
        else:
            labels = labels.withColumnRenamed("root", "was").join(up.select(F.col("node").alias("was"), "root"), "was", "left").select("node", F.coalesce("root", "was").alias("root"))
        labels = stored(labels, f"{folder}/labels-{k}")
        moved = now.join(up.select(F.col("node").alias("high"), F.col("root").alias("a")), "high")
        moved = moved.join(up.select(F.col("node").alias("low"), F.col("root").alias("r")), "low", "left").select("a", F.coalesce("r", "low").alias("b"))
        now = stored(moved.where("a <> b").select(*rows("a", "b")).distinct(), f"{folder}/edges-{k + 1}")
        for done in (f"edges-{k}", *(f"up-{k}-{i}" for i in range(j + 1)), *([f"labels-{k - 1}"] if k else [])):
            remove(spark, f"{folder}/{done}")
        k += 1
    return labels if labels is not None else now.select(F.col("high").alias("node"), F.col("low").alias("root"))
