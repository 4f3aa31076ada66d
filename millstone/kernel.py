"""The digest itself, in numpy and without Spark: build, merge and query sorted weighted centroids.

A digest is compressed in one pass over its sorted points. A scale function maps the share
q of weight to the left of a point to k(q); a cluster takes points while k grows by 1 at
most. As k at a point does not depend on where a cluster began, each cluster's end is found
by one binary search in the array of k, so a pass costs the number of clusters, not points.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from millstone.config import DigestConfig, DigestError, IncompatibleMerge, InvalidTrainingData, factor

#: Slack of the unit step.
STEP_SLACK = 1e-12
#: How near to the largest fitting size the search for a tighter scale comes, as a part of the given size.
SIZE_TOLERANCE = 1e-9
Q_EDGE = 1e-15


@dataclass(frozen=True)
class Parts:
    """A digest's content. ``atomic`` marks centroids that stand for equal values."""

    means: np.ndarray
    weights: np.ndarray
    atomic: np.ndarray
    sum: float
    min: float
    max: float
    config: DigestConfig

    @property
    def count(self) -> float:
        return float(self.weights.sum())

    def __len__(self) -> int:
        return len(self.means)


def empty(cfg: DigestConfig = DigestConfig()) -> Parts:
    none = np.zeros(0)
    return Parts(none, none, np.zeros(0, dtype=bool), 0.0, np.nan, np.nan, cfg)


# --- compression -----------------------------------------------------------------------


def scale_of(q: np.ndarray, family: str, d: float, n: float) -> np.ndarray:
    """k(q) of a scale family with size d; n is the number of points, which k2norm's factor needs."""
    q = np.clip(q, Q_EDGE, 1 - Q_EDGE)
    if family == "quad":
        return d * np.where(q < 0.5, np.sqrt(q / 2), 1 - np.sqrt((1 - q) / 2))
    if family == "k1":
        return d / (2 * np.pi) * np.arcsin(2 * q - 1)
    if family == "k2":
        return d / (4 * np.log(2)) * np.log(q / (1 - q))
    if family == "k2norm":
        return d / (4 * np.log(n / d) + 24) * np.log(q / (1 - q))
    return d / 4 * np.log(np.maximum(np.log(1 / (1 - q)) / np.log(1 / q), Q_EDGE))


def cluster_starts(weights: np.ndarray, family: str, d: float, slack: float = STEP_SLACK) -> np.ndarray:
    """The first point of each cluster."""
    n = len(weights)
    share = np.concatenate(([0.0], np.cumsum(weights)))
    k = scale_of(share / share[-1], family, d, n)
    if k[-1] < k[0]:
        # A falling scale never grows by 1: all is one cluster.
        return np.zeros(1, dtype=np.int64)
    starts, at = [], 0
    if n <= 1 << 15:
        ends = np.maximum(np.searchsorted(k[1:], k[:-1] + 1 + slack, side="right"), np.arange(1, n + 1)).tolist()
        while at < n:
            starts.append(at)
            at = ends[at]
    else:
        after = k[1:]
        while at < n:
            starts.append(at)
            at = max(int(np.searchsorted(after, k[at] + 1 + slack, side="right")), at + 1)
    return np.array(starts, dtype=np.int64)


def _clustered(
    means: np.ndarray, weights: np.ndarray, atomic: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(starts, len(means)))
    total = np.add.reduceat(weights, starts)
    alone = sizes == 1
    mean = np.where(alone, means[starts], np.add.reduceat(means * weights, starts) / total)
    return mean, total, alone & atomic[starts]


def _equal_weight(means: np.ndarray, weights: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``buckets`` runs; each ends where the running weight first reaches its part, the last one at the end."""
    upto = np.cumsum(weights)
    part = upto[-1] / buckets
    cuts = np.zeros(1, dtype=np.int64)
    while len(cuts) < buckets:
        before = upto[cuts[-1] - 1] if cuts[-1] else 0.0
        next_cut = np.searchsorted(upto, before + part) + 1
        if next_cut >= len(weights):
            break
        cuts = np.append(cuts, next_cut)
    return _clustered(means, weights, np.zeros(len(means), dtype=bool), cuts)


def _capped(
    points: tuple[np.ndarray, np.ndarray, np.ndarray], most: int, family: str, d: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` clusters, by the largest size of the scale that gives so few.

    The size is kept in a bracket whose lower end fits and whose upper end does not. A size of nearly
    0 gives one cluster, so a lower end is always known, and its clusters are the result.
    """
    weights = points[1]
    if len(weights) <= most:
        return points
    starts = cluster_starts(weights, family, d)
    if len(starts) > most:
        starts, fits, over = np.zeros(1, dtype=np.int64), 0.0, d
        while over - fits > SIZE_TOLERANCE * d:
            tried = cluster_starts(weights, family, (fits + over) / 2)
            if len(tried) > most:
                over = (fits + over) / 2
            else:
                starts, fits = tried, (fits + over) / 2
    return _clustered(*points, starts)


def _coalesced(
    means: np.ndarray, weights: np.ndarray, atomic: np.ndarray, *, ordered: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by mean, equal means summed; a run is atomic if all of it is."""
    if not ordered:
        order = np.argsort(means)
        means, weights, atomic = means[order], weights[order], atomic[order]
    first = np.flatnonzero(np.concatenate(([True], means[1:] != means[:-1])))
    if len(first) == len(means):
        return means, weights, atomic
    return means[first], np.add.reduceat(weights, first), np.logical_and.reduceat(atomic, first)


def _edges(atomic: np.ndarray, cfg: DigestConfig) -> tuple[int, int, int]:
    """Points kept as they are at either end, and the most clusters between them."""
    n = len(atomic)
    if cfg.policy == "use":
        left, right = min(n, 1), 1 if n > 1 else 0
        return left, right, max(cfg.max_size - left - right, 0)
    if cfg.policy == "edges":
        if n <= 2 * cfg.pin_per_side:
            return n, 0, cfg.max_size
        mixed = np.flatnonzero(~atomic)
        left = min(cfg.pin_per_side, int(mixed[0]) if len(mixed) else n)
        right = min(cfg.pin_per_side, n - 1 - int(mixed[-1]) if len(mixed) else n)
        return left, right, cfg.max_size
    return 0, 0, cfg.max_size


def compress(
    means: np.ndarray,
    weights: np.ndarray,
    atomic: np.ndarray,
    cfg: DigestConfig,
    *,
    low: float,
    high: float,
    ordered: bool = False,
) -> Parts:
    """A digest of weighted points in any order; ``low`` and ``high`` are the values' true range."""
    if not len(means):
        return empty(cfg)
    means, weights, atomic = _coalesced(means, weights, atomic, ordered=ordered)
    total = float((means * weights).sum())
    if cfg.delta is not None:
        out = _clustered(means, weights, atomic, cluster_starts(weights, cfg.scale, cfg.delta, 0.0))
    elif cfg.policy == "off" and len(means) <= cfg.max_size:
        out = (means, weights, atomic)
    else:
        left, right, most = _edges(atomic, cfg)
        points = (means, weights, atomic)
        stop = len(means) - right
        inner = tuple(x[left:stop] for x in points)
        if len(inner[0]):
            inner = _clustered(*inner, cluster_starts(inner[1], cfg.scale, float(cfg.max_size)))
            inner = _capped(inner, max(most, 1), cfg.scale, float(cfg.max_size))
        out = tuple(np.concatenate([p[:left], c, p[stop:]]) for p, c in zip(points, inner, strict=True))
        if cfg.policy == "use" and len(out[0]) > cfg.max_size:
            out = _equal_weight(out[0], out[1], cfg.max_size)
    return _stored(Parts(*out, total, low, high, cfg))


#: Points of a group that are compressed in one piece; a stream of more is clustered by parts of this size.
PART = 1 << 18


class Stream:
    """A digest of distinct values that come in rising order, a batch at a time, by the rules of ``compress``.

    Shares of the weight need its total, which is told beforehand, as are the number of points and the
    weight of the last one. Up to ``PART`` points are held; of more, only the clusters so far. With the
    edges policy all are held, as its pinned ends take from the total what only the end tells.
    """

    def __init__(self, cfg: DigestConfig, n: int, total: float, last: float) -> None:
        self.cfg, self.n = cfg, n
        self.whole = n <= PART or (cfg.policy == "edges" and cfg.delta is None)
        self.pins = 1 if cfg.policy == "use" and cfg.delta is None else 0
        self.inner_total = total - (last if self.pins else 0.0)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.seen, self.sum, self.low, self.high = 0, 0, 0.0, np.nan, np.nan
        self.ends: list[tuple[float, float]] = []
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: Of the inner points so far: their weight; and the open cluster: its k, points, weight, sum, and first value.
        self.before = 0.0
        self.open: tuple[float, int, float, float, float] | None = None

    def feed(self, values: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((values, weights))
        self.size += len(values)
        while not self.whole and self.size >= PART:
            self._cluster(PART)

    def _cluster(self, many: int) -> None:
        """Take ``many`` held points, so that a part begins at the same point however they came."""
        m, w = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [(m[many:], w[many:])], self.size - many
        m, w = m[:many], w[:many]
        if not self.seen:
            self.low = float(m[0])
        self.seen, self.high, self.sum = self.seen + many, float(m[-1]), self.sum + float((m * w).sum())
        if self.pins and not self.ends:
            self.ends.append((float(m[0]), float(w[0])))
            self.inner_total -= float(w[0])
            m, w = m[1:], w[1:]
        if self.pins and self.seen == self.n:
            self.ends.append((float(m[-1]), float(w[-1])))
            m, w = m[:-1], w[:-1]
        if not len(m):
            return
        upto = np.cumsum(np.concatenate(([self.before], w)))
        self.before = float(upto[-1])
        size, slack = (self.cfg.delta, 0.0) if self.cfg.delta is not None else (float(self.cfg.max_size), STEP_SLACK)
        points = self.n - 2 * self.pins
        k = scale_of(np.minimum(upto / self.inner_total, 1.0), self.cfg.scale, size, points)
        ends_of = scale_of(np.array([0.0, 1.0]), self.cfg.scale, size, points)
        falling = ends_of[1] < ends_of[0]
        starts, at = [], 0
        if self.open is not None:
            at = len(m) if falling else int(np.searchsorted(k[1:], self.open[0] + 1 + slack, side="right"))
            self.open = self._with(self.open, m[:at], w[:at])
            if at == len(m):
                return
            self._close()
        while at < len(m):
            starts.append(at)
            at = len(m) if falling else max(int(np.searchsorted(k[1:], k[at] + 1 + slack, side="right")), at + 1)
        whole, last = starts[:-1], starts[-1]
        if whole:
            cut = slice(whole[0], last)
            self.made.append(
                _clustered(m[cut], w[cut], np.ones(last - whole[0], dtype=bool), np.array(whole) - whole[0])
            )
        self.open = self._with((float(k[last]), 0, 0.0, 0.0, float(m[last])), m[last:], w[last:])

    @staticmethod
    def _with(now: tuple[float, int, float, float, float], m: np.ndarray, w: np.ndarray) -> tuple:
        return now[0], now[1] + len(m), now[2] + float(w.sum()), now[3] + float((m * w).sum()), now[4]

    def _close(self) -> None:
        _, n, weight, total, first = self.open
        self.made.append((np.array([first if n == 1 else total / weight]), np.array([weight]), np.array([n == 1])))
        self.open = None

    def close(self) -> Parts:
        """The digest, after the last values."""
        if self.whole:
            m, w = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (
                np.zeros(0), np.zeros(0)
            )
            if not len(m):
                return empty(self.cfg)
            return compress(
                m, w, np.ones(len(m), dtype=bool), self.cfg, low=float(m[0]), high=float(m[-1]), ordered=True
            )
        if self.size:
            self._cluster(self.size)
        if self.open is not None:
            self._close()
        inner = tuple(np.concatenate(x) for x in zip(*self.made, strict=True))
        if self.cfg.delta is None:
            inner = _capped(inner, max(self.cfg.max_size - 2 * self.pins, 1), self.cfg.scale, float(self.cfg.max_size))
        out = inner
        if self.pins:
            (first, first_weight), (last, last_weight) = self.ends
            out = (
                np.concatenate([[first], inner[0], [last]]),
                np.concatenate([[first_weight], inner[1], [last_weight]]),
                np.concatenate([[True], inner[2], [True]]),
            )
        return _stored(Parts(*out, self.sum, self.low, self.high, self.cfg))


def _stored(d: Parts) -> Parts:
    """Rounded to the digest's precision; centroids that meet by rounding are one."""
    if d.config.precision == "f64" or not len(d):
        return d
    means = d.means.astype(np.float32).astype(np.float64)
    if not np.isfinite(means).all():
        raise InvalidTrainingData("a value does not fit f32")
    means, weights, atomic = _coalesced(means, d.weights, d.atomic)
    return replace(
        d,
        means=means,
        weights=weights.astype(np.float32).astype(np.float64),
        atomic=atomic,
        min=float(np.float32(d.min)),
        max=float(np.float32(d.max)),
    )


# --- build and change ------------------------------------------------------------------


def _points(values: np.ndarray, weights: np.ndarray | None, cfg: DigestConfig) -> tuple[np.ndarray, np.ndarray]:
    values = np.asarray(values, dtype=np.float64)
    if cfg.precision == "f32":
        with np.errstate(over="ignore"):
            values = values.astype(np.float32).astype(np.float64)
    if not np.isfinite(values).all():
        raise InvalidTrainingData("values must be finite" + (" as f32" if cfg.precision == "f32" else ""))
    if weights is None:
        return values, np.ones(len(values))
    weights = np.asarray(weights, dtype=np.float64)
    if len(weights) != len(values):
        raise InvalidTrainingData(f"{len(values)} values and {len(weights)} weights")
    if not (np.isfinite(weights).all() and (weights > 0).all()):
        raise InvalidTrainingData("weights must be finite and positive")
    return values, weights


def build(values: np.ndarray, weights: np.ndarray | None = None, cfg: DigestConfig = DigestConfig()) -> Parts:
    """A digest of values, each with a weight (1 by default)."""
    alike = weights is None
    values, weights = _points(values, weights, cfg)
    if not len(values):
        return empty(cfg)
    if alike:
        values = np.sort(values)
    return compress(
        values,
        weights,
        np.ones(len(values), dtype=bool),
        cfg,
        low=float(values.min()),
        high=float(values.max()),
        ordered=alike,
    )


def from_centroids(
    means: np.ndarray,
    weights: np.ndarray,
    cfg: DigestConfig,
    *,
    atomic: np.ndarray | None = None,
    low: float | None = None,
    high: float | None = None,
) -> Parts:
    """A digest of given centroids; they are compressed only where they are more than its size."""
    means, weights = _points(means, weights, cfg)
    if not len(means):
        return empty(cfg)
    kind = np.ones(len(means), dtype=bool) if atomic is None else np.asarray(atomic, dtype=bool)
    low = float(means.min()) if low is None else low
    high = float(means.max()) if high is None else high
    if len(means) > cfg.max_size or cfg.delta is not None:
        return compress(means, weights, kind, cfg, low=low, high=high)
    means, weights, kind = _coalesced(means, weights, kind)
    return _stored(Parts(means, weights, kind, float((means * weights).sum()), low, high, cfg))


def merge(digests: list[Parts], *, strict: bool = True, copies: list[int] | None = None) -> Parts:
    """One digest of all, in one pass, so their order does not matter. ``copies``: how often each counts.

    Empty digests only lend their settings where all are empty. Digests of different precisions
    never merge, empty ones included. Strict: other settings that differ are an error as well; else
    the first non-empty digest's hold.
    """
    if strict and len({d.config.precision for d in digests}) > 1:
        raise IncompatibleMerge("digests differ in precision: f32 and f64; cast_precision makes precisions equal")
    times = [1] * len(digests) if copies is None else copies
    full = [(d, n) for d, n in zip(digests, times, strict=True) if len(d)]
    if not full:
        return empty(digests[0].config) if digests else empty()
    cfg = full[0][0].config
    if strict:
        for d, _ in full[1:]:
            if found := cfg.differences(d.config):
                raise IncompatibleMerge(
                    "digests differ in "
                    + "; ".join(found)
                    + ("; cast_precision makes precisions equal" if "precision" in found[0] else "")
                )
    if len(full) == 1 and full[0][1] == 1:
        return full[0][0]
    means, atomic = np.concatenate([d.means for d, _ in full]), np.concatenate([d.atomic for d, _ in full])
    weights = np.concatenate([d.weights * n for d, n in full])
    out = compress(means, weights, atomic, cfg, low=min(d.min for d, _ in full), high=max(d.max for d, _ in full))
    return replace(out, sum=float(sum(d.sum * n for d, n in full)))


def add(d: Parts, values: np.ndarray, weights: np.ndarray | None = None) -> Parts:
    """The digest with more values; none leaves it as it is."""
    values, weights = _points(values, weights, d.config)
    if not len(values):
        return d
    low, high = float(values.min()), float(values.max())
    if len(d):
        low, high = min(low, d.min), max(high, d.max)
    out = compress(
        np.concatenate([d.means, values]),
        np.concatenate([d.weights, weights]),
        np.concatenate([d.atomic, np.ones(len(values), dtype=bool)]),
        d.config,
        low=low,
        high=high,
    )
    return replace(out, sum=(d.sum if len(d) else 0.0) + float((values * weights).sum()))


def scale_weights(d: Parts, f: float) -> Parts:
    f = factor(f)
    return replace(d, weights=d.weights * f, sum=d.sum * f) if len(d) else d


def scale_values(d: Parts, f: float) -> Parts:
    f = factor(f)
    return _stored(replace(d, means=d.means * f, sum=d.sum * f, min=d.min * f, max=d.max * f)) if len(d) else d


def cast(d: Parts, precision: str) -> Parts:
    if precision not in ("f32", "f64"):
        raise DigestError(f"a digest is cast to f32 or f64; got {precision!r}")
    return _stored(replace(d, config=replace(d.config, precision=precision)))


# --- queries ---------------------------------------------------------------------------


def quantiles(d: Parts, probes: np.ndarray) -> np.ndarray:
    """Values at shares of the weight; NaN for an empty digest or a NaN probe, probes are clipped to [0, 1].

    A share q is the index q * count among the weights. Within one unit of either end it is the
    minimum or the maximum. Else it lies between the centres of two centroids: strictly within an
    atomic pile, or within half a unit of a single value, it is that value; otherwise linear between
    the two, without the half units of single values. Beyond the outer centres it is the outer
    value where that is atomic, else linear towards the minimum or the maximum.
    """
    q = np.asarray(probes, dtype=np.float64)
    out = np.full(q.shape, np.nan)
    known = ~np.isnan(q)
    if not len(d) or not known.any():
        return out
    if len(d) == 1:
        out[known] = d.means[0]
        return out
    total = d.count
    at = np.clip(q[known], 0, 1) * total
    m, w, atomic = d.means, d.weights, d.atomic
    centre = np.cumsum(w) - w / 2
    left = np.clip(np.searchsorted(centre, at, side="right") - 1, 0, len(d) - 2)
    right = left + 1
    to_left, to_right = at - centre[left], centre[right] - at
    dead_left, dead_right = np.where(w[left] == 1, 0.5, 0.0), np.where(w[right] == 1, 0.5, 0.0)
    a, b = to_left - dead_left, to_right - dead_right
    span = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        got = np.where(span <= 0, (m[left] + m[right]) / 2, (m[left] * b + m[right] * a) / span)
        below = d.min + (m[0] - d.min) * at / (w[0] / 2)
        above = m[-1] + (d.max - m[-1]) * (at - centre[-1]) / (w[-1] / 2)
    rules = [
        (at < 1, d.min),
        (at > total - 1, d.max),
        (at < centre[0], m[0] if atomic[0] else below),
        (at >= centre[-1], m[-1] if atomic[-1] else above),
        (atomic[left] & (w[left] > 1) & (np.abs(to_left) < w[left] / 2), m[left]),
        (atomic[right] & (w[right] > 1) & (np.abs(to_right) < w[right] / 2), m[right]),
        ((w[left] == 1) & (to_left < 0.5), m[left]),
        ((w[right] == 1) & (to_right < 0.5), m[right]),
    ]
    out[known] = np.clip(
        np.select([r for r, _ in rules], [np.broadcast_to(v, at.shape) for _, v in rules], got), d.min, d.max
    )
    return out


def quantile(d: Parts, q: float) -> float:
    return float(quantiles(d, np.array([q]))[0])


def median(d: Parts) -> float:
    """For an odd whole count the quantile at one half; for an even one the mean of the two centroids around it."""
    total = d.count
    if total <= 0:
        return float("nan")
    if int(total) % 2:
        return quantile(d, 0.5)
    if len(d) == 1:
        return float(d.means[0])
    centre = np.cumsum(d.weights) - d.weights / 2
    at = 0.5 * total
    if len(d) == 2 or total <= 2 or at < 1:
        left = 0
    else:
        left = int(np.clip(np.searchsorted(centre, at, side="right") - 1, 0, len(d) - 2))
    return float((d.means[left] + d.means[left + 1]) / 2)


def cdf(d: Parts, probes: np.ndarray) -> np.ndarray:
    """Share of weight at or below each probe, half of it at a probe's own mass; NaN for an empty digest or a NaN probe.

    Between two centroids weight grows linearly, but the half of an atomic centroid lies at its
    value, so between two atomic ones the share is level.
    """
    x = np.asarray(probes, dtype=np.float64)
    out = np.full(x.shape, np.nan)
    known = ~np.isnan(x)
    if not len(d) or not known.any():
        return out
    v = x[known]
    m, w = d.means, d.weights
    before = np.cumsum(w) - w
    total = float(w.sum())
    n = len(d)
    place = np.searchsorted(m, v, side="left")
    hit = (place < n) & (m[np.minimum(place, n - 1)] == v)
    own = np.minimum(place, n - 1)
    left, right = np.clip(place - 1, 0, n - 1), own
    half_l, half_r = w[left] / 2, w[right] / 2
    at_l, at_r = np.where(d.atomic[left], half_l, 0.0), np.where(d.atomic[right], half_r, 0.0)
    low_gap, high_gap = m[0] - d.min, d.max - m[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (
            before[left] + half_l + at_l + (half_l + half_r - at_l - at_r) * (v - m[left]) / (m[right] - m[left])
        ) / total
        low = (1 + (v - d.min) / low_gap * (w[0] / 2 - 1)) / total
        high = 1 - (1 + (d.max - v) / high_gap * (w[-1] / 2 - 1)) / total
    rules = [
        (hit, (before[own] + w[own] / 2) / total),
        ((place == 0) & ((v < d.min) | (low_gap <= 0)), 0.0),
        ((place == 0) & (v == d.min), 0.5 / total),
        (place == 0, low),
        ((place == n) & ((v > d.max) | (high_gap <= 0)), 1.0),
        ((place == n) & (v == d.max), 1 - 0.5 / total),
        (place == n, high),
    ]
    out[known] = np.select([r for r, _ in rules], [np.broadcast_to(y, v.shape) for _, y in rules], between)
    return out


def trimmed_mean(d: Parts, lower: float, upper: float) -> float:
    """Mean of the weight between two shares; NaN for an empty digest."""
    total = d.count
    if total <= 0:
        return float("nan")
    ends = np.cumsum(d.weights)
    taken = np.clip(np.minimum(ends, upper * total) - np.maximum(ends - d.weights, lower * total), 0, None)
    held = taken.sum()
    return float((d.means * taken).sum() / held) if held > 0 else float("nan")


def summary(d: Parts) -> str | None:
    """A line about the digest; None where it is empty."""
    if not len(d):
        return None
    return f"TDigest(n={d.count:.0f}, k={d.config.max_size}, min={d.min:.6f}, p50={quantile(d, 0.5):.6f}, max={d.max:.6f}, centroids={len(d)})"
