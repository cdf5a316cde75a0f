"""Connected components by alternating large-star and small-star rounds; nothing is gathered on the driver.

Tasks may contract the edges that they hold first, a bounded number at a time, so that only what joins the contracted
parts takes rounds: every round is some queries, whose plans and compiled code the driver holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


#: Edges that a task contracts at a time.
EDGES_AT_ONCE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label != (up := label[label])).any():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of edges (a saved table), no more of them and mostly far fewer."""

    def rows(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
            size += len(batch)
            if size >= EDGES_AT_ONCE:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    tasks = max(1, -(-edges.count() // EDGES_AT_ONCE))
    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, work: Workspace, label: str = "components", rounds: int = 60) -> DataFrame:
    """node and component (least node reachable) for every node of edges (a, b); loops and repeats do no harm.

    A RuntimeError tells that the last of the rounds still changed edges.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for k in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(least, "a")
        e = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = work.save(e, f"{label}-{k}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if k > 1:
            work.drop(f"{label}-{k - 2}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
