"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(u, v) to (node, label): label is one node of the component, the same for all of it.

    Every node joins its smallest neighbour, and that one's; nodes that joined become one and
    the links between the rest go into the next round. Each round at least halves the nodes that still
    have links. Links of a node to itself are left out, so a node with no other link gets no row."""
    edges = written(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = edges.select(F.col("u").alias("node"), F.col("u").alias("label")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parents")
        far = near.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        parent = written(near.join(far, near["p"] == far["_u"]).select("u", F.col("_p").alias("p")), "parents")
        if first:
            labels, first = parent.select(F.col("u").alias("node"), F.col("p").alias("label")), False
        else:
            labels = written(labels.join(parent, labels["label"] == parent["u"], "left").select(
                "node", F.coalesce("p", "label").alias("label")), "labels")
        a, b = (parent.select(F.col("u").alias(k), F.col("p").alias(f"_{k}")) for k in ("u", "v"))
        edges = written(edges.join(a, "u").join(b, "v").where("_u != _v").select(
            F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct(), "edges")
    return labels
