"""Digests per group, and digests merged per group.

``histogram`` (the default, at every size): equal values are summed before anything is lost, so
``groupBy(keys, value).count()``, with its map-side combine, spilling and generated code, gives
the kernel exactly what sorting all rows would, one call per group. The digest is the same for any
partitioning of the input. A group's distinct values must fit one task (some 100 million).

``streamed``: the same digest, for groups of any size: a group's distinct values are sorted by
Spark, which spills, and streamed through one task that holds a batch and the clusters so far; a row
that goes before them tells their number and weight. It takes about twice as long for small groups.

``hashed``: values are dealt to a fixed number of shards by a hash, each shard is a histogram,
and shard digests are merged. Rows are shuffled twice; a task holds a shard of a group; the
result does not depend on partitioning.

``partial``: every task digests its own rows, group by group, and only digests are shuffled:
no row ever is. Where values are few or the digest holds them all, the result is the
histogram's; else it depends, within a digest's accuracy, on how the input is partitioned.

Merging sorts a group's digests by a hash of their contents, counts equal ones, and merges in one
pass up to ``FAN`` different ones; of more, ``FAN`` at a time are merged before the rest follow.
A group's digests are first dealt to ``SALTS`` tasks, which merge only where one of them holds
more than ``FAN``, so no task holds more than a fan and the result depends on the digests alone.

Planning runs no job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone import kernel, schema
from millstone.config import DigestConfig, config
from millstone.functions.columns import _build_udf, _merge_udf
from millstone.schema import precision_of

#: Digests merged at once; tasks that a group's digests are dealt to; hash shards of a group by default.
FAN, SALTS, HASH_SHARDS = 256, 32, 64


def _checked(value: Column, cfg: DigestConfig) -> Column:
    """The value as a double; null and non-finite ones stop the query. -0.0 is 0.0."""
    x = value.cast("double")
    if cfg.precision == "f32":
        x = x.cast("float").cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("values must be finite and not null"))).otherwise(x + 0.0)


def _weighed(weight: Column) -> Column:
    w = weight.cast("double")
    bad = w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf"))
    return F.when(bad, F.raise_error(F.lit("weights must be finite and positive"))).otherwise(w)


def _one_row(made: DataFrame, alias: str, cfg: DigestConfig) -> DataFrame:
    """One row, also where there was no input: Spark gives no row for a Python aggregate of nothing."""
    schema = made.select(alias).schema
    none = kernel.empty(cfg)
    row = ([], none.sum, none.min, none.max, 0.0, cfg.max_size, cfg.scale, cfg.policy, cfg.pin_per_side, cfg.delta)
    return made.unionAll(made.sparkSession.createDataFrame([(row,)], schema)).agg(
        _merge_udf(cfg.precision, True)(F.col(alias)).alias(alias)
    )


MODES = ("auto", "histogram", "streamed", "partial", "hashed")


def digest_by(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    weight: Column | str | None = None,
    *,
    alias: str = "digest",
    mode: str = "auto",
    shards: int | None = None,
    max_size: int | None = None,
    **settings: object,
) -> DataFrame:
    """One row per group: the keys and the digest of ``value``. Without keys one row, also for an empty input.

    ``shards``: of the mode hashed, the hash shards of a group (a fixed number by default). With the mode
    auto, more than one asks for partial digests.
    """
    cfg = config(max_size, **settings)
    if mode not in MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}; got {mode!r}")
    if not keys:
        one = digest_by(
            df.withColumn("__all", F.lit(0)),
            ["__all"],
            value,
            weight,
            alias=alias,
            mode=mode,
            shards=shards,
            max_size=max_size,
            **settings,
        )
        return _one_row(one.select(alias), alias, cfg)
    if mode == "auto":
        mode = "partial" if shards is not None and shards > 1 else "histogram"
    x = _checked(F.col(value) if isinstance(value, str) else value, cfg)
    w = F.lit(1.0) if weight is None else _weighed(F.col(weight) if isinstance(weight, str) else weight)
    keys = list(keys)
    rows = df.select(*keys, x.alias("__value"), w.alias("__weight"))
    if mode == "partial":
        return _merged(_partial(rows, keys, cfg), keys, cfg.precision, alias)
    points = rows.groupBy(*keys, "__value").agg(F.sum("__weight").alias("__weight"))
    if mode == "streamed":
        return _streamed(points, keys, cfg, alias)
    build = _build_udf(cfg)
    if mode == "histogram":
        return points.groupBy(*keys).agg(build(F.col("__value"), F.col("__weight")).alias(alias))
    points = points.withColumn("__shard", F.pmod(F.xxhash64("__value"), F.lit(shards or HASH_SHARDS)))
    made = points.groupBy(*keys, "__shard").agg(build(F.col("__value"), F.col("__weight")).alias("__digest"))
    return _merged(made.drop("__shard"), keys, cfg.precision, alias)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where a key column's values are; null is a value."""
    if pa.types.is_nested(column.type):
        column = pa.array(list(map(repr, column.to_pylist())))
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _streamed(points: DataFrame, keys: list[str], cfg: DigestConfig, alias: str) -> DataFrame:
    """One row per group: its digest, of distinct values with their weights."""
    n = len(keys)
    totals = [F.sum("__weight"), F.count(F.lit(1)).cast("double"), F.max_by("__weight", "__value")]
    head = points.groupBy(*keys).agg(*[x.alias(y) for x, y in zip(totals, ("__weight", "__n", "__last"), strict=True)])
    none = F.lit(None).cast("double")
    rows = points.select(*keys, "__value", "__weight", none.alias("__n"), none.alias("__last")).unionByName(
        head.withColumn("__value", none)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[list[pa.Scalar], kernel.Parts]] = []
        now: tuple | None = None
        names: list[pa.Scalar] = []
        stream: kernel.Stream | None = None

        def out() -> pa.RecordBatch:
            columns = [pa.array([x[i].as_py() for x, _ in done], done[0][0][i].type) for i in range(n)]
            made = pa.RecordBatch.from_arrays(
                [*columns, schema.write([d for _, d in done], cfg.precision)], [*keys, alias]
            )
            done.clear()
            return made

        for batch in batches:
            values, weights = (batch.column(n + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            # A group begins with the row that has no value.
            heads = np.flatnonzero(batch.column(n).is_null().to_numpy(zero_copy_only=False))
            cut = np.unique(np.concatenate(([0], heads, [len(batch)])))
            begins = set(heads.tolist())
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a in begins:
                    if stream is not None:
                        done.append((names, stream.close()))
                        if len(done) >= 512:
                            yield out()
                    names = [batch.column(i)[a] for i in range(n)]
                    told = [batch.column(n + i)[a].as_py() for i in (1, 2, 3)]
                    stream = kernel.Stream(cfg, int(told[1]), told[0], told[2])
                    a += 1
                if b > a and stream is not None:
                    stream.feed(values[a:b], weights[a:b])
        if stream is not None:
            done.append((names, stream.close()))
        if done:
            yield out()

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("__value").asc_nulls_first())
    return dealt.mapInArrow(run, f"{kinds}, `{alias}` {schema.ddl(cfg.precision)}")


def _fans(
    batches: Iterator[pa.RecordBatch], keys: list[str], precision: str, strict: bool, last: bool
) -> Iterator[pa.RecordBatch]:
    """keys, __digest, __copies of rows in order of keys and digests: groups of more than ``FAN`` different digests
    shrink; the last pass leaves one each.

    Null digests are left out; a group of nothing else has one empty digest.
    """
    n = len(keys)
    held: list[kernel.Parts] = []
    copies: list[int] = []
    content_of_last: int | None = None
    now: tuple | None = None
    names: list[pa.Scalar] = []
    done: list[tuple[list[pa.Scalar], kernel.Parts, int]] = []

    def close() -> None:
        rows, times = held or [kernel.empty(DigestConfig(precision=precision))], copies or [1]
        if last:
            rows, times = [kernel.merge(rows, strict=strict, copies=times)], [1]
        done.extend((names, d, k) for d, k in zip(rows, times, strict=True))

    def out() -> pa.RecordBatch:
        columns = [pa.array([x[0][i].as_py() for x in done], done[0][0][i].type) for i in range(n)]
        made = pa.RecordBatch.from_arrays(
            [*columns, schema.write([x[1] for x in done], precision), pa.array([x[2] for x in done], pa.int64())],
            [*keys, "__digest", "__copies"],
        )
        done.clear()
        return made

    for batch in batches:
        changed = np.zeros(len(batch), dtype=bool)
        changed[:1] = True
        for i in range(n):
            code = _codes(batch.column(i))
            changed[1:] |= code[1:] != code[:-1]
        valid = batch.column(n).is_valid().to_pylist()
        times, content = batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
        for i, digest in enumerate(schema.read(batch.column(n))):
            if changed[i]:
                key = tuple(repr(batch.column(j)[i].as_py()) for j in range(n))
                if key != now:
                    if now is not None:
                        close()
                        if len(done) >= 2 * FAN:
                            yield out()
                    held, copies, content_of_last, now = [], [], None, key
                    names = [batch.column(j)[i] for j in range(n)]
            if not valid[i]:
                continue
            if content[i] == content_of_last and _alike(held[-1], digest):
                copies[-1] += times[i]
                continue
            if len(held) >= FAN:
                held, copies = [kernel.merge(held, strict=strict, copies=copies)], [1]
            held.append(digest)
            copies.append(times[i])
            content_of_last = content[i]
    if now is not None:
        close()
        yield out()


def _alike(a: kernel.Parts, b: kernel.Parts) -> bool:
    """Whether two digests are equal in settings and content."""
    if a.config != b.config or len(a) != len(b) or (len(a) and (a.sum, a.min, a.max) != (b.sum, b.min, b.max)):
        return False
    return all(np.array_equal(getattr(a, x), getattr(b, x)) for x in ("means", "weights", "atomic"))


def _merged(made: DataFrame, keys: list[str], precision: str, alias: str, strict: bool = True) -> DataFrame:
    """One row per group of ``made`` (keys, __digest), its digests merged."""
    for k in keys:
        if made.schema[k].dataType.typeName() in ("float", "double"):
            # -0.0 and 0.0 are one key, as in any aggregate.
            made = made.withColumn(k, F.col(k) + F.lit(0).cast(made.schema[k].dataType))
    kinds = ", ".join(f"`{k}` {made.schema[k].dataType.simpleString()}" for k in keys)
    to = f"{kinds}, __digest {schema.ddl(precision)}, __copies long"
    content = F.xxhash64("__digest").alias("__content")
    # Null digests may go anywhere: any number of them is one.
    salt = F.when(F.col("__digest").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(
        F.pmod(F.xxhash64("__digest", F.lit(1)), F.lit(SALTS))
    )
    dealt = made.select(*keys, "__digest", F.lit(1).cast("long").alias("__copies"), content, salt.alias("__salt"))
    order = [*keys, "__content", "__copies"]
    few = dealt.repartition(*keys, "__salt").sortWithinPartitions(*keys, "__salt", "__content").drop(
        "__salt"
    ).mapInArrow(lambda b: _fans(b, keys, precision, strict, False), to)
    ready = few.withColumn("__content", F.xxhash64("__digest")).repartition(*keys).sortWithinPartitions(*order)
    return ready.mapInArrow(lambda b: _fans(b, keys, precision, strict, True), to).select(
        *keys, F.col("__digest").alias(alias)
    )


#: Values of a group that wait for the next compression; centroids that a task keeps before it hands its digests on.
PENDING, HELD = 1 << 16, 1 << 21


def _partial(rows: DataFrame, keys: list[str], cfg: DigestConfig) -> DataFrame:
    """keys, __digest: digests of each task's own rows; a group may have several."""
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, kernel.Parts]] = {}
        waiting: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        types: list[pa.DataType] = []

        def settle(key: tuple) -> None:
            if parts := waiting.pop(key, None):
                names, digest = held[key]
                held[key] = (
                    names,
                    kernel.add(digest, np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts])),
                )

        def out() -> Iterator[pa.RecordBatch]:
            for key in list(waiting):
                settle(key)
            done = list(held.values())
            for a in range(0, len(done), 512):
                some = done[a : a + 512]
                columns = [pa.array([names[i] for names, _ in some], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, schema.write([d for _, d in some], cfg.precision)], [*keys, "__digest"]
                )
            held.clear()

        size = 0
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n_keys)]
            values, weights = np.asarray(batch.column(n_keys)), np.asarray(batch.column(n_keys + 1))
            code = np.zeros(len(batch), dtype=np.int64)
            for i in range(n_keys):
                codes = _codes(batch.column(i))
                _, code = np.unique(code * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
            order = np.argsort(code, kind="stable")
            for rows_of in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
                names = [batch.column(i)[int(rows_of[0])].as_py() for i in range(n_keys)]
                key = tuple(map(repr, names))
                if key not in held:
                    held[key] = (names, kernel.empty(cfg))
                parts = waiting.setdefault(key, [])
                parts.append((values[rows_of], weights[rows_of]))
                size += len(rows_of)
                if sum(len(v) for v, _ in parts) >= PENDING:
                    settle(key)
            if size >= HELD:
                for key in list(waiting):
                    settle(key)
                size = sum(len(d) for _, d in held.values())
                if size >= HELD // 2:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, __digest {schema.ddl(cfg.precision)}")


def merge_by(
    df: DataFrame, keys: Sequence[str], digest: str = "digest", *, alias: str = "digest", strict: bool = True
) -> DataFrame:
    """One row per group: its digests merged. Null digests count as empty."""
    precision = precision_of(df.schema[digest].dataType)
    if precision is None:
        raise ValueError(f"{digest} is no digest column")
    if not keys:
        one = merge_by(df.withColumn("__all", F.lit(0)), ["__all"], digest, alias=alias, strict=strict)
        return _one_row(one.select(alias), alias, DigestConfig(precision=precision))
    return _merged(df.select(*keys, F.col(digest).alias("__digest")), list(keys), precision, alias, strict)


def rollup_by(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    *,
    cube: bool = False,
    alias: str = "digest",
    **settings: object,
) -> DataFrame:
    """Digests of all grouping sets of a rollup (or cube): built once at the finest grain, then merged.

    ``level`` is the grouping id.
    """
    keys = list(keys)
    finest = digest_by(df, keys, value, alias="__digest", **settings)
    precision = precision_of(finest.schema["__digest"].dataType) or "f64"
    sets = [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)] if cube else [
        keys[:n] for n in range(len(keys), -1, -1)
    ]
    kind = {k: finest.schema[k].dataType for k in keys}
    rows = []
    for some in sets:
        level = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in some)
        rows.append(
            F.struct(
                *[(F.col(k) if k in some else F.lit(None).cast(kind[k])).alias(k) for k in keys],
                F.lit(level).alias("level"),
            )
        )
    spread = finest.select(F.explode(F.array(*rows)).alias("__set"), "__digest").select(
        *[F.col("__set")[k].alias(k) for k in [*keys, "level"]], "__digest"
    )
    return _merged(spread, [*keys, "level"], precision, alias)


def with_digest(
    df: DataFrame, keys: Sequence[str], value: Column | str, *, alias: str = "digest", **settings: object
) -> DataFrame:
    """Every row with its group's digest, as an aggregate over a window would give it, but by a join: no group meets in
    one task."""
    keys = list(keys)
    made = digest_by(df, keys, value, alias="__digest", **settings)
    other = made.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__digest").alias(alias))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(other[f"__key{i}"])
    return df.join(other, same, "left").drop(*[f"__key{i}" for i in range(len(keys))])
