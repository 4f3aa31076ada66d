"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors with equal labels link where their cosine, in double precision, is at least
``least``. Every tree splits recursively by random directions; a vector within ``spill`` times
the spread that a link's difference has along a random direction goes to both sides, so a link
is parted rarely, and by all trees almost never. Leaves meet per label; all pairs within a leaf
are compared, in single precision first and in double where that could decide, and a pair that
several leaves hold counts in the first of them alone. So counts of links are exact for the
links found, and no pair is ever emitted: a task returns one row per vector.

The upper levels split at the medians of a bounded sample (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` bytes of distinct vectors in expectation). Below them every node would hold too
few of the sample; there a level has one random direction a tree, and a node splits at its
projection of the mean of the sample's members in the last fitted node above. So depth follows
the number of rows without a limit, and a leaf's size does not grow with the table.

Equal vectors of a label are one class with a weight, found by grouping the vectors themselves;
classes are what is indexed, and are named by their place in a written table. Vectors are shuffled
once per leaf that they reach, in their own precision. A leaf with more than ``block_rows`` classes
is dealt into blocks, and pairs of blocks are tasks.

Recall, and leaves that a vector reaches, of made pairs at a cosine of 0.9801 (64 components, random
unit vectors, a sample of 20,000; the worst case, as closer pairs are found more often):

    trees, spill    depth 5        depth 11         depth 20
    4, 0.4          1.000, 5.5     0.999, 8.0       0.991, 13.9
    4, 0.5          1.000, 5.9     1.000, 9.4       0.998, 18.6
    2, 1.0          1.000, 4.2     0.999, 10.2      0.999, 37.3

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors
without a label link with nothing. Vectors of different lengths never link. Repeated rows
are copies and link, null ids included; a component without any id has a null name. Columns
beside the three named ones are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.components import components, roots
from millstone.llm.shared import column_of, runs, stored

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16 << 20
#: Members of the sample below which a node is not fitted.
SAMPLE_LEAST = 32
TREES, LEAF_ROWS, SPILL = 4, 2048, 0.4
BLOCK_ROWS = 6144
#: Numbers of a tree's nodes; a leaf of a forest is tree * NODES + node.
NODES = 1 << 56
#: Oversized leaves up to this number are broadcast.
BROADCAST_LEAVES = 200_000


@dataclass
class Forest:
    """Per tree the directions and thresholds of its fitted nodes, as a heap, and below them the nodes' centres and each
    level's direction.

    ``margin`` is what spills to both sides.
    """

    directions: list[np.ndarray]
    thresholds: list[np.ndarray]
    centres: list[np.ndarray]
    lower: list[np.ndarray]
    margin: float

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row of unit vectors reaches in any tree, by row."""
        rows, found = [], []
        for t, (direction, threshold, centre, lower) in enumerate(
            zip(self.directions, self.thresholds, self.centres, self.lower, strict=True)
        ):
            row, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
            for _ in range(len(centre).bit_length() - 1):
                side = np.einsum("ij,ij->i", unit[row], direction[node]) - threshold[node]
                left, right = side < self.margin, side >= -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate(
                    [2 * node[left] + 1, 2 * node[right] + 2]
                )
            above = node - (len(centre) - 1)
            for along in lower:
                side = (unit @ along)[row] - (centre @ along)[above]
                left, right = side < self.margin, side >= -self.margin
                row, above = np.concatenate([row[left], row[right]]), np.concatenate([above[left], above[right]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            found.append(node + t * NODES)
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def fit(
    unit: np.ndarray,
    n: int,
    *,
    least: float,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    spill: float = SPILL,
    seed: int = 5,
) -> Forest:
    """Trees for ``n`` rows of a label, split at the medians of the sample of unit vectors as far down as it reaches."""
    wide = unit.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(n / leaf_rows, 1)))))
    fitted = min(depth, max(0, int(np.log2(max(len(unit) / SAMPLE_LEAST, 1)))))
    margin = spill * float(np.sqrt(2 - 2 * least)) / np.sqrt(wide)
    rng = np.random.default_rng(seed)
    forest = Forest([], [], [], [], margin)
    # Trees without a split are all the same.
    for _ in range(trees if depth else 1):
        direction = rng.normal(size=((1 << fitted) - 1, wide))
        direction /= np.linalg.norm(direction, axis=1, keepdims=True)
        lower = rng.normal(size=(depth - fitted, wide))
        lower /= np.linalg.norm(lower, axis=1, keepdims=True)
        threshold = np.zeros(len(direction))
        members = {0: np.arange(len(unit))}
        for node in range(len(direction)):
            own = members.pop(node)
            side = unit[own] @ direction[node]
            threshold[node] = np.median(side) if len(side) else 0.0
            members[2 * node + 1], members[2 * node + 2] = own[side < threshold[node]], own[side >= threshold[node]]
        centre = np.stack(
            [unit[own].mean(axis=0) if len(own) else np.zeros(wide) for _, own in sorted(members.items())]
        )
        forest.directions.append(direction)
        forest.thresholds.append(threshold)
        forest.centres.append(centre)
        forest.lower.append(lower)
    return forest


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _sums(what: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks lie between each two offsets."""
    upto = np.concatenate(([0], np.cumsum(what)))
    return upto[at[1:]] - upto[at[:-1]]


def _encoded(given: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, vector (its components' bytes; null where nothing can link) of every row."""
    id_kind = given.schema["vec_id"].dataType.simpleString()
    number = pa.float32() if kind == "<f4" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.list_(number))
            at = np.asarray(column.offsets, dtype=np.int64)
            size = np.diff(at)
            usable = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(
                zero_copy_only=False
            ) & (size > 0)
            flat = column.values
            present = flat.is_valid().to_numpy(zero_copy_only=False)
            # -0.0 is 0.0, so that equal vectors have equal bytes.
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False) + number.to_pandas_dtype()(0)
            usable &= (_sums(~present | ~np.isfinite(values), at) == 0) & (_sums(values != 0, at) > 0)
            raw = pa.Array.from_buffers(
                pa.large_binary(),
                len(batch),
                [None, pa.py_buffer(at * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))],
            )
            out = raw.take(pa.array(np.arange(len(batch)), mask=~usable))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), out.cast(pa.binary())], ["vec_id", "label", "vector"]
            )

    return given.mapInArrow(run, f"vec_id {id_kind}, label long, vector binary")


def _matrices(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a column of vectors' bytes, one matrix per length."""
    item = np.dtype(kind).itemsize
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(
        np.int64
    )
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    size = np.diff(at)
    for wide in np.unique(size).tolist():
        rows = np.flatnonzero(size == wide)
        if len(rows) == len(size):
            yield rows, data[at[0] : at[-1]].view(kind).reshape(-1, wide // item)
        else:
            yield rows, data[at[rows][:, None] + np.arange(wide)].view(kind).reshape(-1, wide // item)


def _indexed(classes: DataFrame, forests: dict[int, Forest], kind: str, light: bool) -> DataFrame:
    """label, wide, leaf and, unless light, node, weight, vector, leaves: a row per leaf that a class reaches."""
    shared = classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _matrices(batch.column(3), kind) if len(batch) else ():
                wide = matrix.shape[1]
                for a in range(0, len(rows), 1024):
                    some = batch.take(pa.array(rows[a : a + 1024]))
                    if forest := shared.value.get(wide):
                        row, leaf = forest.leaves(_unit(matrix[a : a + 1024]))
                    else:
                        row, leaf = np.arange(len(some)), np.zeros(len(some), dtype=np.int64)
                    spots = [
                        some.column(1).take(pa.array(row)),
                        pa.array(np.full(len(row), wide, dtype=np.int64)),
                        pa.array(leaf),
                    ]
                    if light:
                        yield pa.RecordBatch.from_arrays(spots, ["label", "wide", "leaf"])
                        continue
                    first = np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(first), pa.array(leaf))
                    for b in range(0, len(row), 4096):
                        own = pa.array(row[b : b + 4096])
                        columns = [x.slice(b, 4096) for x in spots]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *columns,
                                some.column(0).take(own),
                                some.column(2).take(own),
                                some.column(3).take(own),
                                lists.take(own),
                            ], ["label", "wide", "leaf", "node", "weight", "vector", "leaves"]
                        )

    more = "" if light else ", node long, weight long, vector binary, leaves array<long>"
    return classes.select("node", "label", "weight", "vector").mapInArrow(
        run, "label long, wide long, leaf long" + more
    )


def _earlier(lists: pa.ListArray, leaf: int) -> np.ndarray:
    """Rows by the leaves before this one that two rows or more share, as 0 and 1."""
    at = np.asarray(lists.offsets, dtype=np.int64)
    flat = np.asarray(lists.values)[at[0] : at[-1]]
    rows = np.repeat(np.arange(len(lists)), np.diff(at))
    before = flat < leaf
    names, place, n = np.unique(flat[before], return_inverse=True, return_counts=True)
    column = np.full(len(names), -1)
    column[n > 1] = np.arange(int((n > 1).sum()))
    out = np.zeros((len(lists), int((n > 1).sum())), dtype=np.float32)
    keep = column[place] >= 0
    out[rows[before][keep], column[place][keep]] = 1
    return out


def _near(unit: np.ndarray, single: np.ndarray, i: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows ``i`` and ``other`` have a cosine of at least ``least``; doubles decide wherever singles
    might err."""
    found = single[i] @ single[other].T
    slack = np.float32(2e-7 * (unit.shape[1] + 16))
    near = found >= np.float32(least) + slack
    x, y = np.nonzero((found >= np.float32(least) - slack) & ~near)
    for a in range(0, len(x), 65_536):
        p, q = x[a : a + 65_536], y[a : a + 65_536]
        near[p, q] = np.einsum("ij,ij->i", unit[i[p]], unit[other[q]]) >= least
    return near


def block_links(
    unit: np.ndarray, weight: np.ndarray, earlier: np.ndarray, right: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of a task's rows: weighted links that no earlier leaf holds, and the rows that links connect.

    Without right rows the left ones meet each other; else left rows meet right rows alone.
    """
    n = len(unit)
    links = np.zeros(n, dtype=np.int64)
    single = unit.astype(np.float32)
    left = np.flatnonzero(~right)
    other = np.flatnonzero(right) if right.any() else left
    label = np.arange(n)
    for a in range(0, len(left), 512):
        i = left[a : a + 512]
        # Among themselves rows meet those from the block's first one on.
        those = other if right.any() else other[a:]
        near = _near(unit, single, i, those, least)
        if not right.any():
            near &= i[:, None] < those[None, :]
        if not near.any():
            continue
        if earlier.shape[1]:
            near &= (earlier[i] @ earlier[those].T) == 0
        links[i] += near @ weight[those]
        links[those] += weight[i] @ near
        x, y = np.nonzero(near)
        label = roots(n, np.concatenate([i[x], np.arange(n)]), np.concatenate([those[y], label]))
    return links, label


def _verified(batches: Iterator[pa.RecordBatch], least: float, kind: str) -> Iterator[pa.RecordBatch]:
    """node, links, root of the linked rows of each task, streamed from rows sorted by task (label, wide, leaf, x,
    y)."""
    for key, table in runs(batches, 5):
        if len(table) < 2:
            continue
        _, wide, leaf = key[:3]
        unit = _unit(next(_matrices(column_of(table, "vector"), kind))[1])
        names, weight = column_of(table, "node").to_numpy(), column_of(table, "weight").to_numpy()
        right = column_of(table, "right").to_numpy(zero_copy_only=False)
        links, label = block_links(unit, weight, _earlier(column_of(table, "leaves"), leaf), right, least)
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some]), pa.array(links[some]), pa.array(names[label[some]])], ["node", "links", "root"]
            )


def forests_of(classes: DataFrame, kind: str, least: float, **how: float) -> dict[int, Forest]:
    """A forest for each length of vector in a bounded sample of the classes; lengths not in it have one leaf, which is
    exact."""
    sizes = classes.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("vector")).alias("bytes")
    ).agg(F.sum("n"), F.max("n"), F.sum("bytes")).first()
    n, most, size = (x or 0 for x in sizes)
    share = min(1.0, SAMPLE_ROWS / max(n, 1), SAMPLE_BYTES / max(size, 1))
    some = classes if share == 1 else classes.where(
        F.pmod(F.xxhash64("label", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))
    )
    column = some.select("vector").toArrow().column(0).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    return {
        matrix.shape[1]: fit(_unit(matrix), most, least=least, **how)
        for _, matrix in _matrices(column.cast(pa.binary()), kind)
    } if len(column) else {}


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    spill: float = SPILL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    given = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).alias("embedding"),
    )
    kind = "<f4" if given.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = _encoded(given, kind)
    known = rows.where("vector is not null")
    classes = known.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    # Named in the written table, so every reader sees the same names, and no two classes share one.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    forests = forests_of(classes, kind, least, trees=trees, leaf_rows=leaf_rows, spill=spill)

    leaf = ["label", "wide", "leaf"]
    counts = _indexed(classes, forests, kind, light=True).groupBy(*leaf).agg(F.count(F.lit(1)).alias("rows"))
    large = stored(
        counts.where(F.col("rows") > block_rows).select(
            *leaf, F.ceil(F.col("rows") / block_rows).cast("int").alias("salts")
        ),
        "vector-leaves",
    )
    n_large = large.count()
    dealt = _indexed(classes, forests, kind, light=False)
    if n_large:
        dealt = dealt.join(F.broadcast(large) if n_large <= BROADCAST_LEAVES else large, leaf, "left").withColumn(
            "salts", F.coalesce("salts", F.lit(1))
        )
        dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(9)), F.col("salts")).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
        )
    else:
        dealt = dealt.withColumn("salt", F.lit(0)).withColumn("other", F.lit(0))
    task = [*leaf, "x", "y"]
    dealt = dealt.select(
        *leaf,
        F.least("salt", "other").alias("x"),
        F.greatest("salt", "other").alias("y"),
        "node",
        "vector",
        "leaves",
        "weight",
        (F.col("salt") > F.col("other")).alias("right"),
    )
    found = stored(
        dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(
            lambda b: _verified(b, least, kind), "node long, links long, root long"
        ),
        "vector-links",
    )

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select("node", "root"), "vector-components")
    full = classes.select("node", "weight", "least").join(linked, "node", "left").join(reached, "node", "left")
    full = full.select(
        "node",
        "least",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    ids = stored(full.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least")
    # Written, so that the joins below have a shuffle on either side and the rows of a large class can be split.
    of_class = stored(full.join(ids, "root").select("node", "n_links", "component_id"), "vector-counts")
    of_row = known.join(classes.select("label", "vector", "node"), ["label", "vector"]).select("vec_id", "node")
    out = of_row.join(of_class, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
