"""Connected parts of many small graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, node, root) of every node of an edge; ``root`` is one node of each connected part. edges: graph, a, b.

    Every node points to its least neighbour if that is smaller. Pointers are followed by doubling (the pointer of the pointer, then of
    that), so a chain of n nodes takes log n joins; then each part so far is one node, and edges between them go on. Parts
    at least halve in number each time.
    """
    rest = stage(edges.select(graph, "a", "b").filter("a <> b").distinct())
    label = None
    while True:
        both = rest.unionByName(rest.select(graph, F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy(graph, F.col("a").alias("node")).agg(F.min("b").alias("m")).select(graph, "node", F.least("node", "m").alias("root")))
        if label is None and up.isEmpty():
            return up
        while True:
            jump = up.select(graph, F.col("node").alias("root"), F.col("root").alias("_next"))
            far = stage(up.join(jump, [graph, "root"]).select(graph, "node", F.col("_next").alias("root"), (F.col("root") != F.col("_next")).alias("_moved")))
            moved = not far.filter("_moved").isEmpty()
            up = far.drop("_moved")
            if not moved:
                break
        of = lambda end: up.select(graph, F.col("node").alias(end), F.col("root").alias("_" + end))
        rest = stage(rest.join(of("a"), [graph, "a"]).join(of("b"), [graph, "b"]).filter("_a <> _b")
                   .select(graph, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if label is None:
            label = up
        else:
            step = up.select(graph, F.col("node").alias("root"), F.col("root").alias("_next"))
            label = stage(label.join(step, [graph, "root"], "left").select(graph, "node", F.coalesce("_next", "root").alias("root")))
        if rest.isEmpty():
            return label
