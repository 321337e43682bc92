"""Connected components by repeated contraction, for edge lists of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltspark.llm.common import saved


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) that connect what the edges u-v connect; loops are dropped."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        # hook roots, so that a chain shortens by more than a step a round
        np.minimum.at(new, label[a], new[b])
        np.minimum.at(new, label[b], new[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > 1 << 20:
            held = [spanning(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) > 1 << 19:
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["u", "v"])
                held = []
            size = sum(len(x[0]) for x in held)
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, spanning(*(np.concatenate(x) for x in zip(*held))))], ["u", "v"])


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node, component`` of every node of ``u long, v long``: component is the least node reachable.

    Each round first replaces the edges of a partition by star edges that connect the same nodes,
    then takes every node's least neighbour as its label and goes on with the edges between labels.
    Labels only fall, so the last one is the least node; each round at least halves the nodes that
    are left.  Rounds are written to folder, in the shared work folder.
    """
    edges = saved(edges.select("u", "v").where("u <> v").mapInArrow(_local, "u long, v long"), folder, "edges0")
    found, k = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        label = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        label = saved(label, folder, f"label{k}")
        at = lambda c, to: label.select(F.col("node").alias(c), F.col("component").alias(to))
        edges = edges.join(at("u", "x"), "u").join(at("v", "y"), "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))
        k += 1
        edges = saved(edges.distinct().mapInArrow(_local, "u long, v long"), folder, f"edges{k}")
        if found is None:
            found = label
        else:
            new = label.select(F.col("node").alias("component"), F.col("component").alias("to"))
            found = found.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found
