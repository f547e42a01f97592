"""Connected components of a written edge table.

Up to LOCAL_EDGES edges (16 bytes each) one task joins them by union-find, which saves a
score of small jobs; beyond, large and small stars alternate.

Each round is two aggregations and joins over edges (Kiveris et al., 2014), so no group is
held in one task; rounds are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, small

LOCAL_EDGES = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        following = root.copy()
        for x in (u, v):
            np.minimum.at(following, root[x], low)
            np.minimum.at(following, x, low)
        while True:  # pointer jumping
            jumped = following[following]
            if np.array_equal(jumped, following):
                break
            following = jumped
        if np.array_equal(following, root):
            return nodes, nodes[root]
        root = following


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if sum(b.num_rows for b in got):
        t = pa.Table.from_batches(got)
        node, label = union_find(t["a"].to_numpy(), t["b"].to_numpy())
        for i in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(label[i : i + (1 << 16)])], names=["node", "label"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (larger or smaller ones) to the least of its closed neighbourhood."""
    if large:
        around = edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, ws: Workspace, tag: str, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the least reachable node."""
    if small(edges, local_edges):
        return edges.select("a", "b").coalesce(1).mapInArrow(_local, "node bigint, label bigint")
    current = ws.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{tag}_0")
    digest = None
    for k in range(1, max_rounds + 1):
        following = ws.write(_star(_star(current, True), False), f"{tag}_{k}")
        row = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        ws.drop(f"{tag}_{k - 1}")
        current = following
        if (row.n, row.s) == digest:
            break
        digest = (row.n, row.s)
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
