"""Where operators keep what executors and the driver both read."""

from __future__ import annotations

import ctypes
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh local one where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millstone-"))
    return base or posixpath.dirname(spark.sparkContext.getCheckpointDir())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder. Spark's writers make it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose
    nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Hand what this process has freed back to the machine: workers outlive their tasks, and wait beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library: it keeps its own counsel.
        pass


def trimmed(of_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task's function that ends with ``trim``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of_batches(batches)
        trim()

    return run


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of ``uri`` and the path in it; a bare path is local, as for Spark without a default store."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def runs(
    batches: Iterator[pa.RecordBatch], n_keys: int, most: int | None = None
) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of rows with equal first ``n_keys`` columns (whole numbers or booleans without nulls) of rows in their
    order.

    A run of more than ``most`` bytes comes in parts.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    now: tuple[int, ...] | None = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_keys)])
        cut = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(batch)]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            key = tuple(keys[:, a].tolist())
            if held and (key != now or (most is not None and size > most)):
                yield now, pa.Table.from_batches(held)
                held, size = [], 0
            now = key
            held.append(batch.slice(a, b - a))
            size += held[-1].nbytes
    if held:
        yield now, pa.Table.from_batches(held)


def column_of(table: pa.Table, name: str) -> pa.Array:
    """A table's column in one piece."""
    whole = table.column(name).combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) and whole.num_chunks == 1 else whole


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column that hold ``most`` bytes at most, or one row."""
    ends = offsets_of(column)
    start, n = 0, len(column)
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def offsets_of(column: pa.Array):
    """Offsets of a string or binary column into its value buffer, one more than rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def running_sum(rows: DataFrame, by: list[str], order: str, n: str, *, fan: int = 1000) -> DataFrame:
    """``rows`` with ``before``: the sum of ``n`` over rows of the same ``by`` columns and a lower ``order`` (whole
    numbers, one row each).

    Two levels: sums within ``fan`` neighbouring numbers, and along the sums of these, so the longest
    window of one task has a thousandth of the rows. The rows are few against what they count.
    """
    cell = rows.withColumn("__cell", F.floor(F.col(order) / fan))
    along = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by, "__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cell.groupBy(*by, "__cell").agg(F.sum(n).alias("__n")).withColumn(
        "__base", F.coalesce(F.sum("__n").over(along), F.lit(0))
    ).drop("__n")
    joined = cell.join(cells, [*by, "__cell"])
    return joined.withColumn("before", F.col("__base") + F.coalesce(F.sum(n).over(within), F.lit(0))).drop(
        "__cell", "__base"
    )


def copies_of(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``, which numbers equal rows from 0; they are counted, never gathered."""
    return numbered(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")), "__n")


def numbered(counted: DataFrame, n: str, *, run: int = 10_000) -> DataFrame:
    """Each row ``n`` times, ``copy`` from 0, without ``n``. Rows of very many copies are dealt to tasks by runs of
    these first."""
    few = counted.where(F.col(n) <= run).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    runs_ = counted.where(F.col(n) > run).withColumn(
        "__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{n}` - 1) div {run}L")))
    )
    first = F.col("__run") * F.lit(run)
    many = runs_.repartition("__run").withColumn(
        "copy", F.explode(F.sequence(first, F.least(first + F.lit(run), F.col(n)) - 1))
    )
    return few.drop(n).unionByName(many.drop(n, "__run"))


#: 64-bit words of a part of a bitmap that a task puts together.
PART_WORDS = 1 << 12


def bitmap_of(items: DataFrame, most: int) -> np.ndarray:
    """The bitmap of a column of longs (named item): 16 bits an item or so, ``most`` bits at most; parts of it are made
    by tasks."""
    bits = min(most, max(64 * PART_WORDS, 1 << (16 * items.count()).bit_length()))
    wide = 64 * PART_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            part, place = (batch.column(i).to_numpy() for i in (0, 1))
            for p in np.unique(part).tolist():
                own = place[part == p]
                words = made.setdefault(p, np.zeros(PART_WORDS, dtype=np.uint64))
                np.bitwise_or.at(words, own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(made), pa.int64()), pa.array([w.tobytes() for w in made.values()], pa.binary())],
            ["part", "words"],
        )

    bit = F.pmod(F.col("item"), F.lit(bits))
    dealt = items.select(
        F.floor(bit / wide).alias("part"), F.pmod(bit, F.lit(wide)).cast("long").alias("place")
    ).repartition("part")
    got = dealt.mapInArrow(run, "part long, words binary").toArrow()
    out = np.zeros((bits // wide, PART_WORDS), dtype=np.uint64)
    for part, words in zip(got.column("part").to_pylist(), got.column("words").to_pylist(), strict=True):
        out[part] |= np.frombuffer(words, dtype=np.uint64)
    return out.ravel()


def in_bitmap(words: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Whether a bit of a bitmap is set for each item."""
    bit = items.view(np.uint64) % np.uint64(len(words) * 64)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
