"""Digests as files of raw bytes; columns of digests need none of this, Parquet holds them as they are."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone import functions as M


def read_digest_files(spark: SparkSession, path: str, precision: str = "f64") -> DataFrame:
    """path, digest of every file of a folder or pattern."""
    return spark.read.format("binaryFile").load(path).select("path", M.from_bytes("content", precision).alias("digest"))


def write_digest_files(
    digests: DataFrame, folder: str, digest: str = "digest", *, version: int | None = None
) -> DataFrame:
    """One ``.tdig`` file per row; returns the other columns and each row's ``file``.

    The frame that is returned writes when it is computed; names are new each time, so a task that
    runs again leaves the earlier files unused.
    """
    rows = digests.withColumn(digest, M.to_bytes(digest, version))
    place = rows.columns.index(digest)
    others = [c for c in rows.columns if c != digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(folder)
        for batch in batches:
            files = []
            for raw in batch.column(place).to_pylist():
                name = f"{uuid.uuid4().hex}.tdig"
                fs.create_dir(base, recursive=True)
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(raw)
                files.append(f"{folder}/{name}")
            kept = [batch.column(i) for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(files, pa.string())], [*others, "file"])

    schema = rows.select(*others, F.lit("").alias("file")).schema
    return rows.mapInArrow(run, schema)


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it; a bare path is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
