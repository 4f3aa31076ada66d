"""Digest settings, validated once."""

from __future__ import annotations

import math
from dataclasses import dataclass

DEFAULT_MAX_SIZE = 1000
DEFAULT_DELTA = 300.0

# Names of the scale families, edge policies and precisions.
SCALES = ("quad", "k1", "k2", "k3", "k2norm")
POLICIES = ("off", "use", "edges")
PRECISIONS = ("f32", "f64")

SMALLEST, LARGEST = 10, 20_000


class DigestError(ValueError):
    """Any violation of a digest's contract."""


class InvalidTrainingData(DigestError):
    """Null or non-finite values, non-positive weights, lists of different lengths."""


class InvalidProbe(DigestError):
    """A probability outside [0, 1], a null or a malformed probe."""


class InvalidScale(DigestError):
    """A scale factor that is not finite and positive."""


class IncompatibleMerge(DigestError):
    """Digests of different precision or settings."""


class DecodeError(DigestError):
    """Bytes that are not a digest."""


@dataclass(frozen=True)
class DigestConfig:
    """What a digest is built with. ``delta`` replaces ``max_size`` and fixes scale and policy."""

    max_size: int = DEFAULT_MAX_SIZE
    scale: str = "k2"
    policy: str = "use"
    pin_per_side: int = 0
    delta: float | None = None
    precision: str = "f64"

    def differences(self, other: DigestConfig) -> list[str]:
        names = ("precision", "max_size", "scale", "policy", "pin_per_side", "delta")
        return [
            f"{n} {getattr(self, n)} and {getattr(other, n)}" for n in names if getattr(self, n) != getattr(other, n)
        ]


def _one_of(value: object, known: tuple[str, ...], what: str) -> str:
    name = str(getattr(value, "value", value)).strip().lower()
    if name not in known:
        raise DigestError(f"{what} must be one of {', '.join(known)}; got {value!r}")
    return name


def _whole(value: object, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        try:
            if isinstance(value, bool) or int(value) != value:  # type: ignore[call-overload]
                raise TypeError
        except (TypeError, ValueError):
            raise TypeError(f"{what} must be an integer; got {type(value).__name__}") from None
    return int(value)  # type: ignore[call-overload]


def config(
    max_size: int | None = None, *, scale: str | None = None, singleton_policy: str | None = None, pin_per_side: int | None = None, delta: float | None = None, precision: str | None = None, bounded: bool = True
) -> DigestConfig:
    """Settings from user arguments; every rule is checked here, when a plan is made.

    ``bounded`` false admits any positive size (decoded digests keep the size they were written with).
    """
    prec = "f64" if precision in (None, "auto") else _one_of(precision, PRECISIONS, "precision")
    if delta is not None:
        if max_size is not None:
            raise DigestError("give max_size or delta, not both")
        if isinstance(delta, bool) or not isinstance(delta, (int, float)):
            raise TypeError(f"delta must be a number; got {type(delta).__name__}")
        if not math.isfinite(delta) or delta <= 0:
            raise DigestError("delta must be finite and positive")
        if scale is not None and _one_of(scale, SCALES, "scale") != "k2norm":
            raise DigestError("with delta the scale is k2norm")
        if singleton_policy is not None and _one_of(singleton_policy, POLICIES, "singleton_policy") != "off":
            raise DigestError("with delta the singleton policy is off")
        if pin_per_side is not None:
            raise DigestError("pin_per_side does not go with delta")
        return DigestConfig(DEFAULT_MAX_SIZE, "k2norm", "off", 0, float(delta), prec)
    size = DEFAULT_MAX_SIZE if max_size is None else _whole(max_size, "max_size")
    if size < (SMALLEST if bounded else 1) or (bounded and size > LARGEST):
        raise DigestError(f"max_size must be from {SMALLEST} to {LARGEST}; got {size}")
    policy = "use" if singleton_policy is None else _one_of(singleton_policy, POLICIES, "singleton_policy")
    pin = 0
    if policy == "edges":
        if pin_per_side is None:
            raise DigestError("the edges policy needs pin_per_side")
        pin = _whole(pin_per_side, "pin_per_side")
        if pin < 1 or (bounded and pin > size // 2):
            raise DigestError(f"pin_per_side must be from 1 to {size // 2}; got {pin}")
    elif pin_per_side is not None:
        raise DigestError("pin_per_side goes with the edges policy only")
    return DigestConfig(size, "k2" if scale is None else _one_of(scale, SCALES, "scale"), policy, pin, None, prec)


def probability(q: float) -> float:
    """A probe of a quantile, checked."""
    if q is None or isinstance(q, bool) or not math.isfinite(q) or not 0 <= q <= 1:
        raise InvalidProbe(f"a quantile's probe must be finite and from 0 to 1; got {q!r}")
    return float(q)


def bounds(lower: float, upper: float) -> tuple[float, float]:
    """Bounds of a trimmed mean, checked."""
    if not (math.isfinite(lower) and math.isfinite(upper)) or not 0 <= lower < upper <= 1:
        raise InvalidProbe(f"bounds must satisfy 0 <= lower < upper <= 1; got {lower!r} and {upper!r}")
    return float(lower), float(upper)


def factor(f: float) -> float:
    """A scale factor, checked."""
    if f is None or isinstance(f, bool) or not math.isfinite(f) or f <= 0:
        raise InvalidScale(f"a scale factor must be finite and positive; got {f!r}")
    return float(f)
