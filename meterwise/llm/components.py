"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import written


def _flat(pointers: DataFrame) -> DataFrame:
    """Every node's pointer (node, root) followed to its end, by doubling; a root points to
    itself, so the number of rounds is the logarithm of the longest path."""
    while True:
        over = pointers.select(F.col("node").alias("mid"), F.col("root").alias("end"))
        step = written(pointers.withColumnRenamed("root", "mid").join(over, "mid").select("node", "mid", F.col("end").alias("root")), "pointers")
        moved = step.where("root <> mid").limit(1).count()
        pointers = step.select("node", "root")
        if not moved:
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node of ``edges``
    (columns x, y, longs).

    Every round points each node to its least neighbour if that is smaller, follows the
    pointers to their ends, and replaces the edges by those between ends: at least half of
    the nodes that still have edges go. A hub's neighbours are summed up before the shuffle
    (partial minimum); joins on a hub are split by the skew join.
    """
    edges = written(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    labels = None
    while True:
        down = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root"))
        ends = edges.select(F.col("y").alias("node")).distinct()
        pointers = ends.join(down, "node", "left_anti").select("node", F.col("node").alias("root")).union(down)
        pointers = _flat(written(pointers, "pointers"))
        if labels is None:
            labels = pointers
        else:
            over = pointers.select(F.col("node").alias("mid"), F.col("root").alias("end"))
            labels = written(labels.withColumnRenamed("root", "mid").join(over, "mid", "left").select("node", F.coalesce("end", "mid").alias("root")), "labels")
        a = pointers.select(F.col("node").alias("x"), F.col("root").alias("a"))
        b = pointers.select(F.col("node").alias("y"), F.col("root").alias("b"))
        rest = edges.join(a, "x").join(b, "y").where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
        edges = written(rest, "edges")
        if not edges.limit(1).count():
            return labels
