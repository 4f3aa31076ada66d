"""Connected components of a graph given as an edge table, by alternating large and small stars.

Every round is two grouped minima and two joins on node ids, all with map-side combining;
a node with very many neighbours is a hot join key that Spark splits, never a group that is
gathered. Before the rounds each partition contracts its own edges to stars, which leaves
at most one edge per node and partition. Each round's edges are written to the shared
folder, so lineage stays short and a lost executor costs one round at most. Where no more
than ``ONE_TASK`` edges are left (8 MiB), one task contracts them all and no round is needed;
the components are the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.shared import stored


#: Edges that one task contracts to the end.
ONE_TASK = 500_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and edges (a, b): the smallest node that each can reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: (node, smallest node of its component)."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = roots(len(names), flat[: len(a)], flat[len(a) :])
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of a partition's edges; contracted again whenever a million have gathered."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size > 1_000_000:
            u, v = stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            if len(u) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                held, size = [], 0
            else:
                held, size = [(u, v)], len(u)
    if held:
        u, v = stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node of its component) of every node that is not its own root. ``edges``: two long
    columns."""
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long")
    now = stored(now.distinct(), name)
    before = None
    while True:
        if now.count() <= ONE_TASK:
            return stored(now.repartition(1).mapInArrow(_contract, "u long, v long").toDF("node", "root"), name)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        now = stored(small.distinct(), name)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
