"""Column functions. Aggregates and the functions that need the kernel are Arrow UDFs; the rest is built in.

Functions of a digest act row by row: merging is always an explicit ``merge_tdigests``.
``tdigest(col)`` works in any aggregate or window, on the raw rows of a group; for large
groups use ``millstone.operators.digest_by``, which gives the same digest from a histogram
that Spark aggregates first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millstone import kernel, schema, wire
from millstone.config import (
    DecodeError,
    DigestConfig,
    IncompatibleMerge,
    InvalidProbe,
    InvalidTrainingData,
    bounds,
    config,
    factor,
    probability,
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _values(column: pa.Array, what: str = "values") -> np.ndarray:
    if column.null_count:
        raise InvalidTrainingData(f"{what} must not be null")
    return np.asarray(column.cast(pa.float64()))


def _one(d: kernel.Parts) -> pa.Scalar:
    return schema.write([d], d.config.precision)[0]


# --- aggregates ------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _build_udf(cfg: DigestConfig) -> Callable:
    @arrow_udf(schema.ddl(cfg.precision))
    def build(values: pa.Array, weights: pa.Array) -> pa.Scalar:
        return _one(kernel.build(_values(values), _values(weights, "weights"), cfg))

    return build


@lru_cache(maxsize=256)
def _plain_udf(cfg: DigestConfig) -> Callable:
    @arrow_udf(schema.ddl(cfg.precision))
    def build(values: pa.Array) -> pa.Scalar:
        return _one(kernel.build(_values(values), None, cfg))

    return build


def tdigest(values: Column | str, max_size: int | None = None, **settings: object) -> Column:
    """Aggregate: the digest of a numeric column. Nulls and non-finite values are errors."""
    return _plain_udf(config(max_size, **settings))(_col(values).cast("double"))


def tdigest_weighted(
    values: Column | str, weights: Column | str, max_size: int | None = None, **settings: object
) -> Column:
    """Aggregate: the digest of a column with a weight in another, each finite and positive."""
    return _build_udf(config(max_size, **settings))(_col(values).cast("double"), _col(weights).cast("double"))


@lru_cache(maxsize=8)
def _merge_udf(precision: str, strict: bool) -> Callable:
    @arrow_udf(schema.ddl(precision))
    def merge(digests: pa.Array) -> pa.Scalar:
        return _one(
            kernel.merge(list(schema.read(digests)) or [kernel.empty(DigestConfig(precision=precision))], strict=strict)
        )

    return merge


def merge_tdigests(digests: Column | str, *, precision: str = "f64", strict: bool = True) -> Column:
    """Aggregate: one digest of all. Null rows are empty digests; different settings are an error."""
    return _merge_udf(precision, strict)(_col(digests))


# --- row functions ---------------------------------------------------------------------


def _per_row(digests: pa.Array, of: Callable[[kernel.Parts], float], *, null_if_empty: bool = True) -> pa.Array:
    out = [None if null_if_empty and not len(d) else of(d) for d in schema.read(digests)]
    return pa.array(out, pa.float64())


@lru_cache(maxsize=256)
def _quantile_udf(q: float) -> Callable:
    @arrow_udf("double")
    def of(digests: pa.Array) -> pa.Array:
        return _per_row(digests, lambda d: kernel.quantile(d, q))

    return of


@lru_cache(maxsize=256)
def _quantiles_udf(qs: tuple[float, ...]) -> Callable:
    probes = np.array(qs)

    @arrow_udf("array<double>")
    def of(digests: pa.Array) -> pa.Array:
        return pa.array(
            [kernel.quantiles(d, probes).tolist() if len(d) else None for d in schema.read(digests)],
            pa.list_(pa.float64()),
        )

    return of


@lru_cache(maxsize=1)
def _quantile_at_udf() -> Callable:
    @arrow_udf("double")
    def of(digests: pa.Array, q: pa.Array) -> pa.Array:
        probes = [probability(x) for x in q.to_pylist()]
        return pa.array(
            [kernel.quantile(d, x) if len(d) else None for d, x in zip(schema.read(digests), probes, strict=True)],
            pa.float64(),
        )

    return of


def _as(value: Column, precision: str, array: bool = False) -> Column:
    """A digest's value in its precision."""
    kind = "float" if precision == "f32" else "double"
    return value.cast(f"array<{kind}>" if array else kind)


def quantile(digest: Column | str, q: float | list[float] | Column, *, precision: str = "f64") -> Column:
    """The value at a share from 0 to 1, a float with the precision f32; a list gives an array. Null for an empty
    digest."""
    if isinstance(q, Column):
        return _as(_quantile_at_udf()(_col(digest), q.cast("double")), precision)
    if isinstance(q, (list, tuple, np.ndarray)):
        return _as(_quantiles_udf(tuple(probability(float(x)) for x in q))(_col(digest)), precision, array=True)
    return _as(_quantile_udf(probability(q))(_col(digest)), precision)


@lru_cache(maxsize=1)
def _median_udf() -> Callable:
    @arrow_udf("double")
    def of(digests: pa.Array) -> pa.Array:
        return _per_row(digests, kernel.median)

    return of


def median(digest: Column | str, *, precision: str = "f64") -> Column:
    """The median, a float with the precision f32; null for an empty digest."""
    return _as(_median_udf()(_col(digest)), precision)


@lru_cache(maxsize=256)
def _trimmed_udf(lower: float, upper: float) -> Callable:
    @arrow_udf("double")
    def of(digests: pa.Array) -> pa.Array:
        return _per_row(digests, lambda d: kernel.trimmed_mean(d, lower, upper))

    return of


def trimmed_mean(digest: Column | str, lower: float, upper: float, *, precision: str = "f64") -> Column:
    """Mean of the weight between two shares, a float with the precision f32; null for an empty digest."""
    return _as(_trimmed_udf(*bounds(lower, upper))(_col(digest)), precision)


@lru_cache(maxsize=1)
def _cdf_udf() -> Callable:
    @arrow_udf("double")
    def of(digests: pa.Array, x: pa.Array) -> pa.Array:
        if x.null_count:
            raise InvalidProbe("a probe of a cdf must not be null")
        probes = np.asarray(x)
        return pa.array(
            [float(kernel.cdf(d, probes[i : i + 1])[0]) for i, d in enumerate(schema.read(digests))], pa.float64()
        )

    return of


@lru_cache(maxsize=1)
def _cdfs_udf() -> Callable:
    @arrow_udf("array<double>")
    def of(digests: pa.Array, x: pa.Array) -> pa.Array:
        if x.null_count or x.flatten().null_count:
            raise InvalidProbe("a probe of a cdf must not be null")
        offsets = np.asarray(x.offsets, dtype=np.int64)
        probes = np.asarray(x.values)
        out = [kernel.cdf(d, probes[offsets[i] : offsets[i + 1]]) for i, d in enumerate(schema.read(digests))]
        return pa.array(out, pa.list_(pa.float64()))

    return of


def cdf(digest: Column | str, x: float | list[float] | Column, *, array: bool = False) -> Column:
    """Share of weight up to a value: a number, a list (an array), or a column (``array`` for one of arrays).

    NaN for an empty digest or a NaN probe; null probes are errors.
    """
    if isinstance(x, Column):
        return _cdfs_udf()(_col(digest), x.cast("array<double>")) if array else _cdf_udf()(
            _col(digest), x.cast("double")
        )
    if isinstance(x, (list, tuple, np.ndarray)):
        if any(p is None for p in x):
            raise InvalidProbe("a probe of a cdf must not be null")
        return _cdfs_udf()(
            _col(digest), F.array(*[F.lit(float(p)) for p in x]) if len(x) else F.array().cast("array<double>")
        )
    if x is None:
        raise InvalidProbe("a probe of a cdf must not be null")
    return _cdf_udf()(_col(digest), F.lit(float(x)))


def _lists(column: pa.Array, what: str) -> list[np.ndarray]:
    """Rows of a column of numbers or of lists, as arrays; nulls are errors, lists may be empty."""
    if column.null_count:
        raise InvalidTrainingData(f"{what} must not be null")
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        return list(np.asarray(column.cast(pa.float64()))[:, None])
    flat, offsets = column.values, np.asarray(column.offsets, dtype=np.int64)
    own = flat.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    if own.null_count:
        raise InvalidTrainingData(f"{what} must not hold nulls")
    numbers = np.asarray(own.cast(pa.float64()))
    return [numbers[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@lru_cache(maxsize=8)
def _add_udf(precision: str, weighted: bool) -> Callable:
    def changed(digests: pa.Array, values: pa.Array, weights: pa.Array | None) -> pa.Array:
        v = _lists(values, "values")
        w = [None] * len(v) if weights is None else _lists(weights, "weights")
        return schema.write(
            [kernel.add(d, a, b) for d, a, b in zip(schema.read(digests), v, w, strict=True)], precision
        )

    if weighted:

        @arrow_udf(schema.ddl(precision))
        def add_weighted(digests: pa.Array, values: pa.Array, weights: pa.Array) -> pa.Array:
            return changed(digests, values, weights)

        return add_weighted

    @arrow_udf(schema.ddl(precision))
    def add(digests: pa.Array, values: pa.Array) -> pa.Array:
        return changed(digests, values, None)

    return add


def add_values(digest: Column | str, values: Column | float | list[float], *, precision: str = "f64") -> Column:
    """The digest with a number, a list, or a column of either added."""
    return _add_udf(precision, False)(_col(digest), _argument(values))


def add_weighted_values(
    digest: Column | str,
    values: Column | float | list[float],
    weights: Column | float | list[float],
    *,
    precision: str = "f64",
) -> Column:
    """The digest with weighted values added; both numbers, or both lists of equal length."""
    return _add_udf(precision, True)(_col(digest), _argument(values), _argument(weights))


def _argument(x: Column | float | list[float]) -> Column:
    if isinstance(x, (Column, str)):
        return _col(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        if any(v is None for v in x):
            raise InvalidTrainingData("values must not be null")
        return F.array(*[F.lit(float(v)) for v in x]) if len(x) else F.array().cast("array<double>")
    if x is None:
        raise InvalidTrainingData("values must not be null")
    return F.lit(float(x))


@lru_cache(maxsize=256)
def _of_array_udf(cfg: DigestConfig) -> Callable:
    @arrow_udf(schema.ddl(cfg.precision))
    def of(values: pa.Array) -> pa.Array:
        return schema.write([kernel.build(v, None, cfg) for v in _lists(values, "values")], cfg.precision)

    return of


def tdigest_of_array(values: Column | str, max_size: int | None = None, **settings: object) -> Column:
    """The digest of each row's array."""
    return _of_array_udf(config(max_size, **settings))(_col(values).cast("array<double>"))


@lru_cache(maxsize=256)
def _from_centroids_udf(cfg: DigestConfig) -> Callable:
    @arrow_udf(schema.ddl(cfg.precision))
    def of(means: pa.Array, weights: pa.Array) -> pa.Array:
        return schema.write(
            [
                kernel.from_centroids(m, w, cfg)
                for m, w in zip(_lists(means, "means"), _lists(weights, "weights"), strict=True)
            ],
            cfg.precision,
        )

    return of


def from_centroids(
    means: Column | str, weights: Column | str, max_size: int | None = None, **settings: object
) -> Column:
    """A digest of each row's arrays of means and weights."""
    return _from_centroids_udf(config(max_size, **settings))(
        _col(means).cast("array<double>"), _col(weights).cast("array<double>")
    )


# --- built-in only ---------------------------------------------------------------------


def scale_weights(digest: Column | str, f: float, *, precision: str = "f64") -> Column:
    """Weights, count and sum times a finite positive factor."""
    d, by = _col(digest), F.lit(factor(f))
    return _rebuilt(d, precision, weight=lambda c: c["weight"] * by, sum=d["sum"] * by, count=d["count"] * by)


def scale_values(digest: Column | str, f: float, *, precision: str = "f64") -> Column:
    """Means, sum, minimum and maximum times a finite positive factor."""
    d, by = _col(digest), F.lit(factor(f))
    return _rebuilt(
        d, precision, mean=lambda c: c["mean"] * by, sum=d["sum"] * by, min=d["min"] * by, max=d["max"] * by
    )


def _rebuilt(
    d: Column, precision: str, *, mean: Callable | None = None, weight: Callable | None = None, **fields: Column
) -> Column:
    def centroid(c: Column) -> Column:
        return F.struct(
            (mean(c) if mean else c["mean"]).alias("mean"),
            (weight(c) if weight else c["weight"]).alias("weight"),
            c["atomic"].alias("atomic"),
        )

    columns = {n: d[n] for n in schema.FIELDS} | {"centroids": F.transform(d["centroids"], centroid)} | fields
    return F.when(d.isNotNull(), F.struct(*[columns[n].alias(n) for n in schema.FIELDS])).cast(schema.ddl(precision))


#: The largest number that f32 holds.
F32_MAX = float(np.finfo(np.float32).max)


def cast_precision(digest: Column | str, precision: str) -> Column:
    """The digest in f32 or f64, by a cast of the struct; means beyond f32 are an error."""
    if precision not in ("f32", "f64"):
        raise ValueError(f"a digest is cast to f32 or f64; got {precision!r}")
    d = _col(digest)
    made = d.cast(schema.ddl(precision))
    if precision == "f64":
        return made
    return F.when(
        F.exists(d["centroids"], lambda c: F.abs(c["mean"]) > F32_MAX),
        F.raise_error(F.lit("a value does not fit f32")).cast(schema.ddl(precision)),
    ).otherwise(made)


def digest_mean(digest: Column | str) -> Column:
    """sum / count; 0 for an empty digest."""
    d = _col(digest)
    return F.when(d["count"] > 0, d["sum"] / d["count"]).otherwise(F.lit(0.0))


@lru_cache(maxsize=1)
def _summary_udf() -> Callable:
    @arrow_udf("string")
    def of(digests: pa.Array) -> pa.Array:
        return pa.array([kernel.summary(d) for d in schema.read(digests)], pa.string())

    return of


def tdigest_summary(digest: Column | str) -> Column:
    """A line about each digest; null for an empty one."""
    return _summary_udf()(_col(digest))


# --- bytes -----------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _encode_udf(version: int) -> Callable:
    @arrow_udf("binary")
    def of(digests: pa.Array) -> pa.Array:
        return pa.array([wire.encode(d, version) for d in schema.read(digests)], pa.binary())

    return of


def to_bytes(digest: Column | str, version: int | None = None) -> Column:
    """Each digest's bytes, in the latest version by default."""
    version = wire.LATEST if version is None else version
    if version not in (1, 2, 3):
        raise ValueError(f"there are versions 1, 2 and 3; got {version!r}")
    return _encode_udf(version)(_col(digest))


@lru_cache(maxsize=4)
def _decode_udf(precision: str) -> Callable:
    @arrow_udf(schema.ddl(precision))
    def of(blobs: pa.Array) -> pa.Array:
        if blobs.null_count:
            raise DecodeError("null bytes are no digest")
        return schema.write([wire.decode(b, precision) for b in blobs.to_pylist()], precision)

    return of


def from_bytes(blob: Column | str, precision: str = "f64", *, of: DataFrame | None = None) -> Column:
    """The digest of each row's bytes; its precision is part of the type and is verified.

    ``auto`` reads the headers of all blobs of the frame ``of`` first, in any mixture of versions; blobs of
    both precisions are an error.
    """
    if precision == "auto" and of is not None:
        kinds = of.select(_col(blob).alias("blob"))
        return _decode_udf(infer_column_precision(kinds, "blob"))(_col(blob))
    if precision not in ("f32", "f64"):
        raise ValueError("a column of digests is f32 or f64; auto needs the frame to read, as of=")
    return _decode_udf(precision)(_col(blob))


@lru_cache(maxsize=1)
def _precision_udf() -> Callable:
    @arrow_udf("string")
    def of(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None else wire.wire_precision(b) for b in blobs.to_pylist()], pa.string())

    return of


def wire_precision(blob: Column | str) -> Column:
    """f32 or f64; null for null."""
    return _precision_udf()(_col(blob))


def infer_column_precision(df: DataFrame, column: str, *, strict: bool = True) -> str:
    """The one precision of all of a column's blobs; f64 where there are none, or, not strict, where they differ."""
    kinds = sorted(
        r[0]
        for r in df.where(F.col(column).isNotNull()).select(wire_precision(column).alias("p")).distinct().collect()
    )
    if len(kinds) > 1 and strict:
        raise IncompatibleMerge(f"column {column} holds digests of f32 and f64")
    return kinds[0] if len(kinds) == 1 else "f64"


# --- SQL -------------------------------------------------------------------------------


def register(spark: SparkSession, max_size: int | None = None, **settings: object) -> list[str]:
    """Register SQL functions; the settings are those of the digests that SQL builds. Returns the names."""
    cfg = config(max_size, **settings)
    p = cfg.precision
    made = {
        "tdigest": _plain_udf(cfg),
        "tdigest_weighted": _build_udf(cfg),
        "merge_tdigests": _merge_udf(p, True),
        "tdigest_of_array": _of_array_udf(cfg),
        "tdigest_quantile": _quantile_at_udf(),
        "tdigest_cdf": _cdf_udf(),
        "tdigest_cdf_array": _cdfs_udf(),
        "tdigest_median": _median_udf(),
        "tdigest_trimmed_mean": _trimmed_at_udf(),
        "tdigest_add_values": _add_udf(p, False),
        "tdigest_add_weighted_values": _add_udf(p, True),
        "tdigest_to_bytes": _encode_udf(wire.LATEST),
        "tdigest_from_bytes": _decode_udf(p),
        "tdigest_wire_precision": _precision_udf(),
        "tdigest_summary": _summary_udf(),
        "tdigest_from_centroids": _from_centroids_udf(cfg),
        "tdigest_scale_weights": _scaled_udf(p, "weights"),
        "tdigest_scale_values": _scaled_udf(p, "values"),
        "tdigest_to_f32": _cast_udf("f32"),
        "tdigest_to_f64": _cast_udf("f64"),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    return sorted(made)


@lru_cache(maxsize=1)
def _trimmed_at_udf() -> Callable:
    @arrow_udf("double")
    def of(digests: pa.Array, lower: pa.Array, upper: pa.Array) -> pa.Array:
        ends = [bounds(a, b) for a, b in zip(lower.to_pylist(), upper.to_pylist(), strict=True)]
        return pa.array(
            [kernel.trimmed_mean(d, *e) if len(d) else None for d, e in zip(schema.read(digests), ends, strict=True)],
            pa.float64(),
        )

    return of


@lru_cache(maxsize=8)
def _scaled_udf(precision: str, what: str) -> Callable:
    change = kernel.scale_weights if what == "weights" else kernel.scale_values

    @arrow_udf(schema.ddl(precision))
    def of(digests: pa.Array, f: pa.Array) -> pa.Array:
        return schema.write([change(d, x) for d, x in zip(schema.read(digests), f.to_pylist(), strict=True)], precision)

    return of


@lru_cache(maxsize=2)
def _cast_udf(precision: str) -> Callable:
    @arrow_udf(schema.ddl(precision))
    def of(digests: pa.Array) -> pa.Array:
        return schema.write([kernel.cast(d, precision) for d in schema.read(digests)], precision)

    return of
