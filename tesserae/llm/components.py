"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b), both long; label: the least node of the component.

    Every round, each node points to the least of itself and its neighbours; pointers are followed twice, again
    and again, until all lead to roots (a chain of n nodes takes log3 n steps), and the edges follow to the roots.
    Those inside a root and those that repeat vanish, and at least half of the nodes with edges do, so
    that the rounds grow with the logarithm of the nodes and the rows shrink from round to round.
    Each table of a round is written to the shared folder; only whether a pointer moved or an edge is
    left reaches the driver. The edges of a node of very many neighbours meet its pointer in a sort-merge
    join, whose large partitions adaptive execution splits.
    """
    rest = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = None
    while rest.limit(1).count():
        up = stored(rest.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "up")
        moved = True
        while moved:
            above = up.select(F.col("a").alias("node"), F.col("up").alias("next"))
            twice = up.join(above, F.col("up") == F.col("node")).select("a", F.col("next").alias("up"))
            far = stored(twice.join(above, F.col("up") == F.col("node")).select("a", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "up")
            moved = far.where("moved").limit(1).count() > 0
            discard(up)
            up = far
        up = up.select("a", "up")
        if labels is None:
            after = stored(up.select(F.col("a").alias("node"), F.col("up").alias("label")), "labels")
        else:
            after = stored(labels.join(up, labels.label == up.a, "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
            discard(labels)
        one = rest.join(up, "a").select(F.col("up").alias("x"), "b")
        two = one.join(up.withColumnsRenamed({"a": "b", "up": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        fewer = stored(two.where("a != b").distinct(), "edges")
        discard(rest)
        discard(far)
        labels, rest = after, fewer
    if labels is None:
        empty = rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
        empty._tesserae_path = rest._tesserae_path
        return empty
    discard(rest)
    return labels
