"""Connected components of an edge table, by rounds of joins that contract it to stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm import storage

ROUNDS = 60
#: Edges of a task at least: a round starts several stages anew, and most rounds are over few edges.
EDGES_PER_TASK = 200_000
#: Edges that a task contracts at once.
HELD = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, least node) of each node tied by edges (``a``, ``b``), but for the least ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    tied = root != np.arange(len(nodes))
    return np.column_stack([nodes[tied], nodes[root[tied]]])


def _tied_in_tasks(edges: DataFrame) -> DataFrame:
    """The edges of each task contracted to stars, a bounded number at once; the components stay the same."""
    def run(batches):
        held = [np.zeros((0, 2), np.int64)]
        for batch in batches:
            held.append(np.column_stack([batch.column(k).to_numpy() for k in range(2)]))
            if sum(map(len, held)) > HELD:
                held = [_stars(*np.concatenate(held).T)]
                if len(held[0]) > HELD // 2:
                    yield out(held.pop())
        if held:
            yield out(_stars(*np.concatenate(held).T))

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node and its neighbours are tied to the least node among them; the components stay the same."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u").coalesce(tasks)
    ties = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
    return met.select(F.explode(ties).alias("t")).select("t.*").filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of edges (``a``, ``b``) of longs; the component is its least node.

    Every round is written to shared storage, so a lost executor costs no more than a round. Edges of a node to itself
    and repeated edges are allowed; an empty table gives an empty result. Rounds are joins over all tasks; between them each
    task contracts the edges it holds, and as many tasks run as the edges need, not as the shuffle setting says.
    """
    least_tasks = edges.sparkSession.sparkContext.defaultParallelism
    now = storage.written(edges.filter("a <> b").distinct(), "edges")
    before, tasks = None, max(least_tasks, -(-now.count() // EDGES_PER_TASK))
    for _ in range(ROUNDS):
        now = storage.written(_tied_in_tasks(_contracted(now, tasks)).distinct().coalesce(tasks), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if state == before:
            break
        before, tasks = state, max(least_tasks, -(-state["n"] // EDGES_PER_TASK))
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
