"""Connected components of an edge table by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node that has an edge, with the smallest node of its component.

    ``edges`` is a written table. In a round each node points to the smallest node around it, and
    the trees that arise are flattened to stars. Then the edges between different stars are kept,
    once each, as edges of their centres, so that many edges in a group cost one pass; a centre is
    the smallest node of its star, and the smallest node of a component is always a centre. A
    node that points nowhere in one round does so in the next, so rounds grow with the logarithm
    of the nodes. Each step is written so that lineage stays short.
    Null ends are ignored, an edge from a node to itself makes it a component, repeated edges
    count once; an empty table gives an empty result.
    """
    rest = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    labels = held = None
    while True:
        both = rest.unionAll(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = _flattened(scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "labels"), scratch)
        at = lambda end, centre: stars.select(F.col("node").alias(end), F.col("label").alias(centre))
        between = rest.join(at("u", "x"), "u").join(at("v", "y"), "v").where(F.col("x") != F.col("y"))
        left = scratch.write(between.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        if labels is None:
            labels = stars
        else:
            merged = scratch.write(labels.join(at("label", "centre"), "label", "left").select("node", F.coalesce("centre", "label").alias("label")), "labels")
            scratch.drop(labels, stars, held)
            labels = merged
        if left.isEmpty():
            return labels
        rest = held = left


def _flattened(trees: DataFrame, scratch: Scratch) -> DataFrame:
    """The written (node, label) with the root of each tree as label: every label is a node, too."""
    while True:
        heads = trees.select(F.col("node").alias("label"), F.col("label").alias("head"))
        step = scratch.write(trees.join(heads, "label").select("node", F.col("head").alias("label"), (F.col("head") != F.col("label")).alias("moved")), "labels")
        still = step.where("moved").isEmpty()
        scratch.drop(trees)
        trees = step
        if still:
            out = step.select("node", "label")
            out.scratch_path = step.scratch_path
            return out
