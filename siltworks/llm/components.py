"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import Batches, arrow_type, parked

#: Edges a task holds at once while it contracts them.
CHUNK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes but the smallest ones."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while not np.array_equal(label[x], label[y]):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge for each node and chunk of a task."""

    def run(batches: Batches) -> Batches:
        out = arrow_type("u long, v long")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            u, v = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=out)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= CHUNK_EDGES:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return edges.select(edges.columns[0], edges.columns[1]).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    ``edges`` has two columns of whole numbers without nulls. Tasks first contract
    what they hold. Then every node's larger neighbours, and its smaller ones,
    are hung on its smallest neighbour in turn until nothing moves, which takes
    a number of rounds that grows with the logarithm of the longest path. Rounds
    are tables in the shared folder; nothing comes to the driver but a checksum.
    """
    pairs = parked(_contracted(edges), f"{label}-edges")
    seen = None
    while True:
        count = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")).first()
        if tuple(count) == seen or not count.n:
            break
        seen = tuple(count)
        ends = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        lowest = ends.groupBy(F.col("e.u").alias("y")).agg(F.min("e.v").alias("low"))
        lowest = parked(lowest.select("y", F.least("y", "low").alias("low")), f"{label}-lowest")
        # Each edge (u, v), u > v, is moved by its smaller end to the smallest of that end's neighbourhood.
        large = pairs.join(lowest, pairs.v == lowest.y).select("u", F.col("low").alias("v"))
        large = parked(large.distinct(), f"{label}-large")
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("low"))
        small = large.join(least, large.u == least.x).select(
            F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")
        )
        pairs = parked(small.select("e.u", "e.v").filter("u <> v").distinct(), f"{label}-pairs")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
