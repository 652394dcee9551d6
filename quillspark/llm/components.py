"""Connected components of a table of links, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import materialize, ship

#: Links up to which one task takes all that are left (16 MB of ends).
FEW = 1 << 20


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links of 64-bit nodes -> (node, comp), one row for each node with a link; comp is one of its nodes.

    Each round hooks every node to its smallest neighbour, jumps twice, and contracts the links. Node ids
    are digests, so labels are random and the rounds grow with the logarithm of the longest path. Once at
    most FEW links are left, one task on an executor does the same rounds over arrays, which spares the stages of each.
    Nothing is sent to the driver but how many links are left; each round is cut from its lineage by a checkpoint.
    Links of a node with itself and null ends are ignored; no links give no rows.
    """
    ship(links.sparkSession)
    left = materialize(_ordered(links.select("a", "b").where("a is not null and b is not null and a <> b")))
    label, size = None, left.count()
    while size:
        if size <= FEW:
            hook = materialize(left.coalesce(1).mapInArrow(_joined, "node long, to long"))
        else:
            ends = left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("to")))
            hook = ends.groupBy("node").agg(F.min("to").alias("to"))
            for _ in range(2):
                other = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
                hook = materialize(hook.join(other, "to").select("node", F.col("further").alias("to")))
        moved = hook.select(F.col("node").alias("comp"), "to")
        label = hook.select("node", F.col("to").alias("comp")) if label is None else materialize(label.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        if size <= FEW:
            break
        a, b = (hook.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        left = materialize(_ordered(left.join(a, "a").join(b, "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
        size = left.count()
    return label if label is not None else left.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) -> (node, the smallest node of its component)."""
    parts = [np.stack([b.column(k).to_numpy() for k in range(2)]) for b in batches]
    nodes, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    up = np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "to"])


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
