"""Digests that follow a stream: one per key in state, or one per closed event-time window.

Spark admits no Python aggregate in a streaming aggregation. A running digest is therefore
kept as bytes in arbitrary state, at most a few kilobytes per key whatever the number of
events. Windows take the other way: a streaming histogram, which Spark aggregates natively
with a watermark, handed to ``digest_by`` in ``foreachBatch`` once a window is closed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millstone import kernel, wire
from millstone.config import InvalidTrainingData, config


def running_digests(
    stream: DataFrame, keys: Sequence[str], value: str, *, max_size: int | None = None, **settings: object
) -> DataFrame:
    """After each batch, a row per key that had events: the keys, ``n`` and the digest's ``blob`` (update mode).

    Nulls and non-finite values stop the stream.
    """
    cfg = config(max_size, **settings)
    keys = list(keys)
    given = stream.select(*keys, F.col(value).cast("double").alias("value"))
    names = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest = kernel.empty(cfg)
        if state.exists:
            digest = wire.decode(state.get[0])
            digest = replace(digest, config=cfg)
        for frame in frames:
            if frame["value"].isna().any():
                raise InvalidTrainingData("values must be finite and not null")
            digest = kernel.add(digest, frame["value"].to_numpy())
        blob = wire.encode(digest)
        state.update((blob,))
        yield pd.DataFrame({k: [v] for k, v in zip(keys, key, strict=True)} | {"n": [digest.count], "blob": [blob]})

    return given.groupBy(*keys).applyInPandasWithState(
        follow, f"{names}, n double, blob binary", "blob binary", "update", GroupStateTimeout.NoTimeout
    )


def windowed_points(
    stream: DataFrame, ts: str, duration: str, keys: Sequence[str], value: str, *, delay: str, slide: str | None = None
) -> DataFrame:
    """A streaming histogram: window, keys, value, n; in append mode a window's rows come once, when the watermark has
    passed it.

    ``digest_by(batch, ["window", *keys], "value", "n")`` in ``foreachBatch`` makes the digests.
    Events later than ``delay`` are dropped, as everywhere in Structured Streaming.
    """
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        # Event time must be a point in time: one without a zone is read as UTC, in any session.
        stream = stream.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))
    window = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    return stream.withWatermark(ts, delay).groupBy(
        window.alias("window"), *keys, F.col(value).cast("double").alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
