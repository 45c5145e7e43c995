"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import held


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reached.

    Each round hangs every node's larger neighbours, and the node itself, on its smallest one, first
    from the large side of each link, then from the small side (alternating large and small stars).
    The rounds needed grow with the logarithm of the links; nothing is collected. A node's
    neighbours are summed inside the tasks before they meet, so a hub is one row per task.
    """
    edges = held(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(),
        "edges",
    )
    while True:
        large = _star(edges.union(edges.select("v", "u")), larger=True)
        small = held(_star(large, larger=False), "edges")
        same = small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return held(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "roots")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of ``u`` to the smallest of them and ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    joined = edges.join(least, edges["u"] == least["hub"])
    apart = "v > u" if larger else "v <> m"
    hung = joined.where(apart).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        hung = hung.union(least.select("hub", "m"))
    return hung.where("u <> v").distinct()
