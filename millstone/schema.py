"""Digests as Spark columns: the struct type, and Arrow conversion both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from millstone.config import DigestConfig
from millstone.kernel import Parts, empty

FIELDS = ("centroids", "sum", "min", "max", "count", "max_size", "scale", "policy", "pin_per_side", "delta")


def ddl(precision: str = "f64") -> str:
    """The digest struct; means, weights, min and max are floats in f32."""
    f = "float" if precision == "f32" else "double"
    return f"struct<centroids:array<struct<mean:{f},weight:{f},atomic:boolean>>,sum:double,min:{f},max:{f},count:double,max_size:int,scale:string,policy:string,pin_per_side:int,delta:double>"


def precision_of(kind: T.DataType) -> str | None:
    """The precision of a digest column's type; None where it is no digest."""
    if not isinstance(kind, T.StructType) or tuple(kind.fieldNames()) != FIELDS:
        return None
    return "f32" if isinstance(kind["min"].dataType, T.FloatType) else "f64"


def arrow_type(precision: str) -> pa.DataType:
    f = pa.float32() if precision == "f32" else pa.float64()
    centroid = pa.struct([("mean", f), ("weight", f), ("atomic", pa.bool_())])
    kinds = [
        pa.list_(centroid),
        pa.float64(),
        f,
        f,
        pa.float64(),
        pa.int32(),
        pa.string(),
        pa.string(),
        pa.int32(),
        pa.float64(),
    ]
    return pa.struct(list(zip(FIELDS, kinds, strict=True)))


def read(column: pa.Array | pa.ChunkedArray) -> Iterator[Parts]:
    """The digests of a struct column; a null row is the default empty digest."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from read(chunk)
        return
    precision = "f32" if pa.types.is_float32(column.type.field("min").type) else "f64"
    field = {n: column.field(i) for i, n in enumerate(FIELDS)}
    lists = field["centroids"]
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    inner = lists.values
    means = np.asarray(inner.field(0).fill_null(0), dtype=np.float64)
    weights = np.asarray(inner.field(1).fill_null(0), dtype=np.float64)
    atomic = inner.field(2).fill_null(False).to_numpy(zero_copy_only=False)
    plain = {n: field[n].to_pylist() for n in FIELDS[1:]}
    valid = column.is_valid().to_pylist()
    for i in range(len(column)):
        if not valid[i]:
            yield empty(DigestConfig(precision=precision))
            continue
        a, b = int(offsets[i]), int(offsets[i + 1])
        cfg = DigestConfig(
            plain["max_size"][i],
            plain["scale"][i],
            plain["policy"][i],
            plain["pin_per_side"][i] or 0,
            plain["delta"][i],
            precision,
        )
        low, high = plain["min"][i], plain["max"][i]
        yield Parts(
            means[a:b],
            weights[a:b],
            atomic[a:b],
            plain["sum"][i] or 0.0,
            np.nan if low is None else low,
            np.nan if high is None else high,
            cfg,
        )


def write(digests: list[Parts], precision: str) -> pa.StructArray:
    """A struct column of digests, all of one precision."""
    f = pa.float32() if precision == "f32" else pa.float64()
    flat = [
        np.concatenate([getattr(d, n) for d in digests])
        if digests else np.zeros(0)
        for n in ("means", "weights", "atomic")
    ]
    centroid = pa.StructArray.from_arrays(
        [pa.array(flat[0], f), pa.array(flat[1], f), pa.array(flat[2].astype(bool))], ["mean", "weight", "atomic"]
    )
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in digests]))).astype(np.int32)
    c = [d.config for d in digests]
    columns = [
        pa.ListArray.from_arrays(pa.array(offsets), centroid),
        pa.array([d.sum for d in digests], pa.float64()),
        pa.array([d.min for d in digests], f),
        pa.array([d.max for d in digests], f),
        pa.array([d.count for d in digests], pa.float64()),
        pa.array([x.max_size for x in c], pa.int32()),
        pa.array([x.scale for x in c], pa.string()),
        pa.array([x.policy for x in c], pa.string()),
        pa.array([x.pin_per_side for x in c], pa.int32()),
        pa.array([x.delta for x in c], pa.float64()),
    ]
    return pa.StructArray.from_arrays(columns, fields=list(arrow_type(precision)))
