"""Connected components: in one task where the edges are proven few, else by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace

#: Edges that one task may hold (32 MB of ids).
ONE_TASK = 2_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) by hooking roots to smaller ones and halving paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the smallest node."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        node, comp = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 100_000]), pa.array(comp[at : at + 100_000])], names=["node", "comp"])


def connected_components(spark: SparkSession, ws: Workspace, edges: DataFrame, name: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """node, comp (smallest node of the component) for every node of ``edges`` (a long, b long), a written table.

    Up to ``one_task`` edges go to one task. More are grouped by node in steps that point neighbours at the smallest one seen, so a
    component of any shape becomes a star in a logarithmic number of rounds. Nothing is collected but one checksum a round.
    """
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() <= one_task:
        return ws.write(edges.coalesce(1).mapInArrow(_local, "node long, comp long"), f"{name}-labels")
    now = ws.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        now = ws.write(small, f"{name}-{step}")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == seen:
            break
        seen = mark
        if step > 1:
            ws.drop(f"{name}-{step - 2}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
