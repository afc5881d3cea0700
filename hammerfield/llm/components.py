"""Connected components of an edge list by alternating large and small stars, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stage


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) of a small edge list."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars around its smallest nodes."""
    for batch in batches:
        if batch.num_rows:
            node, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["u", "v"])


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) of every node of edges (u long, v long); nodes without edges are not listed.

    Each batch of edges is first made into stars on its own. Then, in turn, each node passes its smallest neighbour to
    the larger ones (large star) and to the smaller ones (small star) until nothing changes. Every round groups by
    node for a minimum only and joins it back, so a hub is a skewed join key and never a group in memory; each round is
    written to the shared folder.
    """
    star = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").mapInArrow(_contract, "u long, v long").filter("v < u").distinct()
    star = stage(star, "stars")
    before = None
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("v < u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        star = stage(small, "stars")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
