"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) for every node of links (a, b: long).

    Each round every node hooks to its smallest neighbour, pointers are followed to their end, twice as
    far at each step, and the links are contracted; loops and repeats vanish. A round leaves half of the
    nodes at most, and a chain, in whatever order its nodes are numbered, takes few rounds. All tables
    stay distributed.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "links")
    labels = materialize(edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("comp")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        hook = materialize(hook, "hook")
        moved = True
        while moved:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            further = materialize(hook.select("u", "p").join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "hook")
            discard(hook)
            hook, moved = further, not further.where("moved").isEmpty()
        root = hook.select(F.col("u").alias("comp"), "p")
        new_labels = materialize(labels.join(root, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        pu, pv = hook.select("u", F.col("p").alias("pu")), hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        contracted = edges.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        new_edges = materialize(contracted, "links")
        discard(edges, labels, hook)
        edges, labels = new_edges, new_labels
    discard(edges)
    return labels
