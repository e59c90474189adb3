"""Connected components of links, by alternating large-star and small-star steps.

A step only takes minima over neighbours, so a node that a third of all links share needs no
list of them; its rows meet one minimum in a join that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import staged


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i], for all i."""
        x, y = self.label[a], self.label[b]
        differ = x != y
        if not differ.any():
            return
        lo, hi = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            root = v
            while (up := parent.get(root, root)) != root:
                root = up
            while parent.get(v, v) != root:
                parent[v], v = root, parent[v]
            return root

        both = np.unique(lo * len(self.label) + hi)
        for u, v in zip((both // len(self.label)).tolist(), (both % len(self.label)).tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        old = np.fromiter(parent, dtype=np.int64)
        to = np.arange(len(self.label))
        to[old] = [find(v) for v in old.tolist()]
        self.label = to[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of all that aren't roots."""
        member = np.flatnonzero(self.label != np.arange(len(self.label)))
        return member, self.label[member]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch of links."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.link(place[: len(a)], place[len(a) :])
        member, root = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root])], names=["big", "small"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Links of a node with itself and repeated links change nothing; no links give no rows.
    """
    edges = links.select("a", "b").where("a <> b").mapInArrow(_contract, "big long, small long").distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        after = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).first())
        if after == before or not after[0]:
            break
        before = after
        both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).union(edges.select("small", "big"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("small"), F.least("u", "m").alias("m"))
        large = staged(edges.join(lowest, "small").select("big", F.col("m").alias("small")).distinct(), "large")
        lowest = large.groupBy("big").agg(F.min("small").alias("m"))
        moved = large.join(lowest, "big").where("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        edges = staged(moved.union(lowest.select("big", F.col("m").alias("small"))).distinct(), "small")
    roots = edges.select(F.col("small").alias("node")).distinct()
    return edges.select(F.col("big").alias("node"), F.col("small").alias("component")).union(roots.select("node", F.col("node").alias("component")))
