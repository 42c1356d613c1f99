"""Connected components of an edge list by alternating large-star and small-star steps.

All state is (u, v) edges in staged tables; hubs are met by partial aggregation and a join that
adaptive execution may split, never by collecting a node's neighbours. Up to FEW edges are put together by
one task instead, as a round of steps costs the driver a plan of eight shuffles however few edges there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import lean, stage


#: Edges (16 bytes each) that one task puts together.
FEW = 1 << 20


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of edges, by least neighbours and pointer jumps."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        nodes, root = roots_of(*map(np.concatenate, zip(*held, strict=True)))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.record_batch({"node": pa.array(nodes[i : i + (1 << 16)], pa.int64()), "root": pa.array(root[i : i + (1 << 16)], pa.int64())})


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for every node of links (a, b), root being the least node of its component; nodes are longs."""
    edges = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= few:
        return stage(edges.coalesce(1).mapInArrow(lean(_alone), "node long, root long"), "roots")
    seen = None
    for _ in range(most):
        print_ = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not print_[0] or tuple(print_) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v"), F.col("v"))).distinct()
        seen = tuple(print_)
        edges = stage(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components haven't settled after {most} rounds")
