"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import cut, free, join_split


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges once, and the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(one):
        low, high = np.minimum(root[one], root[other]), np.maximum(root[one], root[other])
        np.minimum.at(root, high, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        left = root[one] != root[other]
        one, other = one[left], other[left]
    return nodes, nodes[root]


def connected_components(edges: DataFrame, rounds: int | None = None, gathered: int = 0) -> DataFrame:
    """``node, root`` for every node of the undirected edges ``a, b`` (longs); root is the component's smallest node.

    Each step replaces edges by as many edges to smaller nodes, so that the edge table never grows, and ends in stars after
    about the logarithm of the longest path squared. Only minima per node are aggregated (with map-side combining), and
    joins deal both sides anew, so that the adaptive planner may split a node of very many edges; no node's neighbours are
    ever gathered. Loops and repeated edges are harmless, edges with a null end are dropped. Without edges the result is empty.
    With ``rounds`` the steps end after so many: a root is then some node that the node is connected with. Up to ``gathered``
    edges (16 bytes each) go to the driver instead, which spares the steps' many jobs; the result is that without ``rounds``.
    """
    if gathered:
        edges = cut(edges.select("a", "b").where("a <> b"))
        if edges.count() <= gathered:
            got = edges.toArrow()
            made = pa.table(dict(zip(("node", "root"), stars(*(got.column(c).to_numpy() for c in "ab")), strict=True)))
            return edges.sparkSession.createDataFrame(made) if made.num_rows else edges.toDF("node", "root")
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    print_of = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = print_of(e)
    while now[0] and rounds != 0:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_split(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_split(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        del both, low, large, small
        free(edges.sparkSession)  # a step's shuffles are small, but of many files
        before, now = now, print_of(e)
        if before == now:
            break
        rounds = rounds - 1 if rounds is not None else None
    if rounds == 0:
        e = e.groupBy("a").agg(F.min("b").alias("b"))
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def labelled(nodes: DataFrame, node: str, value: str, links: DataFrame, gathered: int = 0) -> DataFrame:
    """``node``, component_id: the least ``value`` among the nodes that links ``a, b`` connect with each node; nulls are not compared."""
    roots = connected_components(links, gathered=gathered).withColumnRenamed("node", node)
    own = join_split(nodes.select(node, value), roots, node, "left").select(node, value, F.coalesce("root", node).alias("root"))
    least = own.groupBy("root").agg(F.min(value).alias("component_id"))
    return join_split(own.select(node, "root"), least, "root").select(node, "component_id")
