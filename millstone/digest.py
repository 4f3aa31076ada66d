"""A digest as a value on the driver: the same kernel as the distributed operators, without Spark."""

from __future__ import annotations

import base64
import copy
from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from millstone import kernel, wire
from millstone.config import DigestConfig, InvalidTrainingData, bounds, config, probability
from millstone.schema import FIELDS, precision_of


def _numbers(data: Any) -> np.ndarray:
    if isinstance(data, (int, float)) and not isinstance(data, bool):
        data = [data]
    out = np.asarray(data if isinstance(data, np.ndarray) else list(data), dtype=object)
    if any(x is None for x in out.ravel().tolist()):
        raise InvalidTrainingData("values must not be null")
    return out.astype(np.float64).ravel()


class Digest:
    """Mutable; changing methods return the digest itself."""

    def __init__(self, parts: kernel.Parts | None = None) -> None:
        self.parts = kernel.empty() if parts is None else parts

    @classmethod
    def from_array(cls, data: Any, **settings: Any) -> Digest:
        return cls(kernel.build(_numbers(data), None, config(**settings)))

    @classmethod
    def from_means_weights(cls, means: Any, weights: Any, **settings: Any) -> Digest:
        return cls(kernel.from_centroids(_numbers(means), _numbers(weights), config(**settings)))

    @classmethod
    def from_row(cls, row: Any, precision: str) -> Digest:
        """From a value of a collected digest column, whose type alone tells the precision: see ``collected``."""
        if row is None:
            return cls(kernel.empty(DigestConfig(precision=precision)))
        x = row.asDict() if hasattr(row, "asDict") else dict(zip(FIELDS, row, strict=True))
        cents = x["centroids"] or []
        cfg = DigestConfig(x["max_size"], x["scale"], x["policy"], x["pin_per_side"] or 0, x["delta"], precision)
        m, w, a = (np.array([c[i] for c in cents]) for i in range(3))
        return cls(
            kernel.Parts(m.astype(np.float64), w.astype(np.float64), a.astype(bool), x["sum"], x["min"], x["max"], cfg)
        )

    @classmethod
    def collected(cls, df: DataFrame, digest: str = "digest") -> list[Digest]:
        """The digests of a frame's column, in the column's precision; the frame must be small."""
        precision = precision_of(df.schema[digest].dataType)
        if precision is None:
            raise ValueError(f"{digest} is no digest column")
        return [cls.from_row(r[0], precision) for r in df.select(digest).collect()]

    @classmethod
    def merge_all(cls, digests: Iterable[Digest]) -> Digest:
        return cls(kernel.merge([d.parts for d in digests]))

    def merge(self, other: Digest | Iterable[Digest]) -> Digest:
        others = [other] if isinstance(other, Digest) else list(other)
        if any(o is self for o in others):
            raise ValueError("a digest does not merge with itself; copy it first")
        self.parts = kernel.merge([self.parts, *(o.parts for o in others)])
        return self

    def add(self, values: Any) -> Digest:
        self.parts = kernel.add(self.parts, _numbers(values))
        return self

    def add_weighted(self, values: Any, weights: Any) -> Digest:
        self.parts = kernel.add(self.parts, _numbers(values), _numbers(weights))
        return self

    def scale_weights(self, f: float) -> Digest:
        self.parts = kernel.scale_weights(self.parts, f)
        return self

    def scale_values(self, f: float) -> Digest:
        self.parts = kernel.scale_values(self.parts, f)
        return self

    def cast_precision(self, precision: str) -> Digest:
        return Digest(kernel.cast(self.parts, precision))

    def _shaped(self, probes: Any, of: Any) -> Any:
        if isinstance(probes, (int, float)):
            return float(of(np.array([float(probes)]))[0])
        got = of(np.asarray(probes, dtype=np.float64))
        return got if isinstance(probes, np.ndarray) else type(probes)(got.tolist())

    def quantile(self, q: Any) -> Any:
        for p in [q] if isinstance(q, (int, float)) else q:
            probability(float(p))
        return self._shaped(q, lambda a: kernel.quantiles(self.parts, a))

    def cdf(self, x: Any) -> Any:
        return self._shaped(x, lambda a: kernel.cdf(self.parts, a))

    def median(self) -> float:
        return kernel.median(self.parts)

    def trimmed_mean(self, lower: float, upper: float) -> float:
        return kernel.trimmed_mean(self.parts, *bounds(lower, upper))

    def mean(self) -> float:
        return self.parts.sum / self.count if self.count else 0.0

    @property
    def count(self) -> float:
        return self.parts.count

    @property
    def sum(self) -> float:
        return self.parts.sum

    @property
    def min(self) -> float:
        return self.parts.min

    @property
    def max(self) -> float:
        return self.parts.max

    @property
    def means(self) -> list[float]:
        return self.parts.means.tolist()

    @property
    def weights(self) -> list[float]:
        return self.parts.weights.tolist()

    @property
    def config(self) -> DigestConfig:
        return self.parts.config

    def inner_kind(self) -> str:
        return self.config.precision

    def is_empty(self) -> bool:
        return not len(self.parts)

    def summary(self) -> str | None:
        return kernel.summary(self.parts)

    def to_bytes(self, version: int = wire.LATEST) -> bytes:
        return wire.encode(self.parts, version)

    @classmethod
    def from_bytes(cls, raw: bytes, precision: str | None = None) -> Digest:
        return cls(wire.decode(raw, precision))

    def to_dict(self) -> dict[str, Any]:
        return {
            "schema_version": 2,
            "means": self.means,
            "weights": self.weights,
            "wire": base64.b64encode(self.to_bytes()).decode(),
            "delta": self.config.delta,
        }

    @classmethod
    def from_dict(cls, said: dict[str, Any]) -> Digest:
        if said.get("schema_version") != 2 or "wire" not in said:
            raise ValueError("not a digest's dictionary of schema version 2")
        out = cls.from_bytes(base64.b64decode(said["wire"]))
        if said.get("delta") is not None:
            from dataclasses import replace

            out.parts = replace(out.parts, config=replace(out.config, delta=said["delta"]))
        return out

    def __len__(self) -> int:
        return len(self.parts)

    def __copy__(self) -> Digest:
        return Digest(self.parts)

    def __deepcopy__(self, memo: dict[int, Any]) -> Digest:
        return Digest(copy.deepcopy(self.parts, memo))

    def __reduce__(self) -> tuple[Any, ...]:
        return Digest.from_dict, (self.to_dict(),)

    def __repr__(self) -> str:
        return self.summary() or "TDigest(empty)"
