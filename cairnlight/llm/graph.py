"""Connected components of an edge table: in one task where the edges are few, else by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: Edges, of 16 bytes, that one task joins by itself; more are joined in rounds. The result is the same.
FEW = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root[k]) != k:
            root[k] = root[up]
            k = root[k]
        return k

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != b:
                a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(k) for k in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that is reachable) for every node of ``edges`` (a written table; a, b: long)."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if edges.count() <= FEW:
        return written(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
    return in_rounds(edges, rounds)


def in_rounds(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``components`` by joins, which no number of edges is too large for.

    Every round takes the smallest label among a node's neighbours and then the label of its label, so long chains
    shorten by half. Rows of a hot node are pre-aggregated (min) before they meet. Each round is a written table.
    """
    down = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a node's smaller neighbours hang on its smallest one instead: in a dense group that leaves about an edge a node
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    hung = down.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
    hung = written(hung, "hung")
    both = written(hung.union(hung.select("b", "a")), "edges")
    dropped(hung)
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = written(low.join(jump, "low").select("node", F.least("low", "far").alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        dropped(labels)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    dropped(both)
    return labels.select("node", F.col("label").alias("component"))
