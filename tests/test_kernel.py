"""The digest without Spark: golden values, exactness, settings, merging, bytes."""

from __future__ import annotations

import copy
import math
import pickle
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millstone import (
    Digest, DigestError, IncompatibleMerge, InvalidProbe, InvalidScale, InvalidTrainingData, kernel, wire
)
from millstone.config import DecodeError, config

MIXTURE_SEED = 4242


def mixture(n: int) -> np.ndarray:
    """30 % narrow clumps at .1, .5 and .9, 40 % uniform, 30 % power tails, all within [0, 1]."""
    rng = np.random.default_rng(MIXTURE_SEED)
    kind = rng.random(n)
    clump = np.clip(rng.choice([0.1, 0.5, 0.9], n) + rng.uniform(-1e-3, 1e-3, n), 0, 1)
    tail = rng.random(n) ** 4
    tail = np.where(rng.random(n) < 0.5, tail, 1 - tail)
    return np.where(kind < 0.3, clump, np.where(kind < 0.7, rng.random(n), tail))


def test_canonical():
    d = Digest.from_array([0, 1, 2, 3], max_size=10)
    assert (d.quantile(0.5), d.cdf(2.0), d.median()) == (1.5, 0.625, 1.5)
    assert d.cdf([0, 1.5, 3]) == [0.125, 0.5, 0.875]
    assert (d.count, d.sum, d.min, d.max, d.mean()) == (4, 6, 0, 3, 1.5)
    assert isinstance(d.quantile(np.array([0.5])), np.ndarray) and isinstance(d.quantile((0.5,)), tuple)


@pytest.mark.parametrize("precision", ["f32", "f64"])
def test_add(precision):
    d = Digest.from_array([0, 1, 2, 3], max_size=64, precision=precision).add(4).add([5, 6])
    assert d.quantile(0.5) == 3.0 and d.inner_kind() == precision
    assert d.add([]).count == 7


def test_piles():
    d = Digest.from_array([0] * 5 + [10] * 7, max_size=64)
    assert d.weights == [5, 7]
    assert d.cdf([1, 5, 9]) == [5 / 12] * 3 and d.cdf(0) == 2.5 / 12
    assert Digest.from_array([0] * 4 + [1] * 4 + [3] * 8).quantile(0.5) == pytest.approx(5 / 3)
    top = Digest.from_array([0] * 5 + [10] * 5, max_size=64)
    assert top.quantile([0.7, 0.85, 1.0]) == [10, 10, 10]


def test_ties_are_order_statistics():
    values = [-2, -2, -1, 0, 0, 0, 3, 7, 7]
    d = Digest.from_array(values)
    assert d.quantile([(i + 0.5) / 9 for i in range(9)]) == values
    for x in (-3, -2, -1.5, 0, 3, 5, 7, 8):
        assert d.cdf(float(x)) == pytest.approx(sum(1 if v < x else 0.5 if v == x else 0 for v in values) / 9)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 20])
def test_even_split(n):
    d = Digest.from_array([-1] * n + [1] * n, max_size=100)
    assert d.quantile(0.5) == 0 and d.median() == 0


def test_incremental_piles():
    d = Digest.from_array([], max_size=10)
    for x in (1, 1, 1, 2, 1, 1):
        d.add(x)
    assert d.means == [1, 2] and d.quantile([0.5, 0.95]) == [1, 2]


def test_wide_range_and_tails():
    d = Digest.from_array([-10, -1, 0, 0, 2e-10, 1, 2, 10, 1e9, -1e9], max_size=10)
    q = d.quantile(list(np.linspace(0, 1, 101)))
    assert q == sorted(q) and (q[0], q[-1]) == (-1e9, 1e9)
    h = Digest.from_array([-1e9, *range(-29, 69), 1e9], max_size=10, scale="quad")
    assert h.cdf(-1e9) <= 0.01 and h.cdf(1e9) >= 0.99 and abs(h.cdf(20.0) - 0.5) < 0.1


def test_weighted_equals_expanded():
    a = Digest.from_array([], max_size=128).add_weighted([3, -1, 5, 3], [4, 2, 3, 1])
    b = Digest.from_array([3] * 5 + [-1] * 2 + [5] * 3, max_size=128)
    assert (a.means, a.weights, a.sum) == (b.means, b.weights, b.sum) and a.count == 10
    c = Digest.from_means_weights([10, 0], [2, 3], max_size=64)
    assert (c.count, c.sum, c.min, c.max) == (5, 20, 0, 10)


def test_scaling():
    d = Digest.from_array([0, 1, 2, 3], max_size=128).scale_weights(3).scale_values(2)
    assert (d.count, d.sum, d.min, d.max, d.quantile(0.5), d.median()) == (12, 36, 0, 6, 3.0, 3.0)
    for f in (0, -1, math.nan, math.inf):
        for change in (d.scale_weights, d.scale_values):
            with pytest.raises(InvalidScale):
                change(f)


def test_delta_mode():
    d = Digest.from_means_weights(range(5), [100, 1, 1, 1, 1], delta=20)
    assert len(d) == 4 and d.config.scale == "k2norm" and d.config.policy == "off"
    small = Digest.from_array(np.arange(3.0), delta=300)
    assert small.count == 3 and small.min == 0 and small.max == 2


def test_edges_keep_outer_values():
    assert Digest.from_array([0, 1, 2, 3], max_size=10, singleton_policy="edges", pin_per_side=2).means == [0, 1, 2, 3]
    d = Digest.from_array(np.arange(5000.0), max_size=50, singleton_policy="edges", pin_per_side=4)
    assert d.means[:4] == [0, 1, 2, 3] and d.means[-4:] == [4996, 4997, 4998, 4999] and len(d) <= 58


@pytest.mark.parametrize("scale", ["quad", "k1", "k2", "k3"])
@pytest.mark.parametrize("policy", ["off", "use"])
def test_size_weight_and_order(scale, policy):
    values = np.random.default_rng(1).lognormal(size=20_000)
    d = Digest.from_array(values, max_size=200, scale=scale, singleton_policy=policy)
    assert len(d) <= 200 and d.count == 20_000 and d.sum == pytest.approx(values.sum())
    assert (np.diff(d.means) > 0).all() and (d.min, d.max) == (values.min(), values.max())
    q = d.quantile(list(np.linspace(0, 1, 1001)))
    assert (np.diff(q) >= 0).all()
    c = d.cdf(list(np.linspace(values.min() - 1, values.max() + 1, 1001)))
    assert (np.diff(c) >= -1e-15).all() and c[0] == 0 and c[-1] == 1


def test_clusters_equal_the_greedy_rule():
    rng = np.random.default_rng(3)
    for family in ("quad", "k1", "k2", "k3", "k2norm"):
        for _ in range(20):
            n = int(rng.integers(1, 400))
            w = rng.integers(1, 9, n).astype(float)
            d = float(rng.choice([10, 37, 100]))
            share = np.concatenate(([0], np.cumsum(w))) / w.sum()
            k = kernel.scale_of(share, family, d, n)
            want, start = [0], 0
            for i in range(n):
                if i > start and k[i + 1] > k[start] + 1 + kernel.STEP_SLACK and not k[-1] < k[0]:
                    want.append(i)
                    start = i
            assert kernel.cluster_starts(w, family, d).tolist() == want


def test_runs_of_equal_weight():
    """The last resort of digests smaller than their pinned ends: each run ends where it first holds its part."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        weights = rng.integers(1, 9, int(rng.integers(1, 30))).astype(float)
        buckets = int(rng.integers(1, 6))
        means = np.arange(len(weights), dtype=float)
        runs, held = [[]], 0.0
        for m, w in zip(means, weights, strict=True):
            if held >= weights.sum() / buckets and len(runs) < buckets:
                runs.append([])
                held = 0.0
            runs[-1].append((m, w))
            held += w
        got_means, got_weights, atomic = kernel._equal_weight(means, weights, buckets)
        assert got_weights.tolist() == [sum(w for _, w in r) for r in runs] and not atomic.any()
        assert got_means == pytest.approx([sum(m * w for m, w in r) / sum(w for _, w in r) for r in runs])
    for size in (1, 2):
        d = kernel.build(rng.random(500), None, config(size, bounded=False))
        assert len(d) <= size and d.count == 500


def test_the_cap_is_the_largest_size_that_fits():
    rng = np.random.default_rng(13)
    for scale in ("quad", "k1", "k2", "k3"):
        weights = rng.integers(1, 5, 3000).astype(float)
        points = (np.arange(3000.0), weights, np.ones(3000, dtype=bool))
        got = kernel._capped(points, 40, scale, 200.0)
        assert len(got[0]) <= 40 < len(kernel.cluster_starts(weights, scale, 200.0))
        # No larger size, of many that are tried, leaves as few.
        fits = [d for d in np.linspace(1, 200, 4000) if len(kernel.cluster_starts(weights, scale, d)) <= 40]
        assert len(got[0]) == len(kernel.cluster_starts(weights, scale, max(fits))) or abs(len(got[0]) - 40) <= 1


@pytest.mark.parametrize(
    "how",
    [
        {"scale": "quad"},
        {"scale": "k1"},
        {"scale": "k2"},
        {"scale": "k3"},
        {"singleton_policy": "off"},
        {"singleton_policy": "edges", "pin_per_side": 3},
        {"delta": 50.0},
    ],
)
def test_streams_equal_whole_compression(monkeypatch, how):
    """Values in rising order, in batches of any size, in parts smaller than the group."""
    monkeypatch.setattr(kernel, "PART", 700)
    rng = np.random.default_rng(14)
    for _ in range(12):
        values = np.unique(rng.normal(size=int(rng.integers(2, 5000))))
        weights = rng.integers(1, 5, len(values)).astype(float)
        cfg = config(None if "delta" in how else int(rng.choice([10, 50, 200])), **how)
        low, high = values[0], values[-1]
        want = kernel.compress(values, weights, np.ones(len(values), dtype=bool), cfg, low=low, high=high, ordered=True)
        stream, at = kernel.Stream(cfg, len(values), weights.sum(), weights[-1]), 0
        while at < len(values):
            n = int(rng.integers(1, 1500))
            stream.feed(values[at : at + n], weights[at : at + n])
            at += n
        got = stream.close()
        assert got.weights.tolist() == want.weights.tolist() and got.atomic.tolist() == want.atomic.tolist()
        assert got.means == pytest.approx(want.means, rel=1e-12) and (got.min, got.max) == (low, high)
        assert got.sum == pytest.approx(want.sum)


def test_accuracy_of_the_mixture():
    """Pinned errors of a like sample (its draws are not the pinned one's, so the score has a wider tolerance): 100,000
    values, size 1000, quad."""
    values = np.sort(mixture(100_000))
    d = Digest.from_array(values, max_size=1000, scale="quad")
    grid = np.linspace(values[0], values[-1], 1001)
    exact = (np.searchsorted(values, grid, "left") + np.searchsorted(values, grid, "right")) / 2 / len(values)
    error = np.abs(np.array(d.cdf(list(grid))) - exact)
    assert error.max() <= 1.6834e-3 + 5e-4 and error.mean() <= 4.2745e-5 + 5e-6
    assert np.exp(-(1200 * error.mean() + 18 * error.max())) >= 0.92165 - 5e-3
    q = np.arange(1, 1000) / 1000
    off = np.abs(np.array(d.quantile(list(q))) - np.quantile(values, q))
    assert off.max() <= 7.2614e-4 + 5e-4 and off.mean() <= 3.6059e-5 + 5e-6


def test_merge():
    values = np.random.default_rng(2).normal(size=30_000)
    parts = [Digest.from_array(v) for v in np.array_split(values, 13)]
    m = Digest.merge_all(parts)
    assert m.count == 30_000 and (m.min, m.max) == (values.min(), values.max())
    assert Digest.merge_all(parts[::-1]).means == pytest.approx(m.means)
    assert abs(np.searchsorted(np.sort(values), m.quantile(0.9)) / 30_000 - 0.9) < 2e-3
    assert Digest.merge_all([]).config == config() and Digest.merge_all([]).is_empty()
    lossless = Digest.merge_all([Digest.from_array([3, 3, 1, 0]) for _ in range(4)])
    assert lossless.quantile(0.5) == pytest.approx(5 / 3)
    empty = Digest.from_array([], max_size=50)
    assert empty.merge(Digest.from_array([1, 2], max_size=20)).config.max_size == 20
    with pytest.raises(ValueError, match="itself"):
        m.merge(m)


@pytest.mark.parametrize(
    "other", [{"max_size": 50}, {"scale": "k1"}, {"singleton_policy": "off"}, {"precision": "f32"}]
)
def test_merge_refuses_other_settings(other):
    with pytest.raises(IncompatibleMerge, match="cast_precision" if "precision" in other else "differ"):
        Digest.from_array([1, 2]).merge(Digest.from_array([1, 2], **other))


def test_kinds_survive_merging():
    a = Digest.from_array(np.arange(5000.0), max_size=20)
    m = Digest.merge_all([a, Digest.from_array([0.0, 0.0, 0.0], max_size=20)])
    assert m.parts.atomic[0] and not m.parts.atomic[5]
    assert Digest.merge_all([a, Digest.from_array([], max_size=20)]).means == a.means


def test_empty():
    d = Digest.from_array([])
    assert all(
        math.isnan(x)
        for x in (d.quantile(0.5), d.median(), d.cdf(1.0), d.cdf(math.inf), d.trimmed_mean(0.1, 0.9), d.min, d.max)
    )
    assert d.mean() == 0 and d.summary() is None and d.count == 0


def test_probes():
    d = Digest.from_array([1, 2, 3])
    for q in (math.nan, math.inf, -0.1, 1.1):
        with pytest.raises(InvalidProbe):
            d.quantile(q)
    assert math.isnan(d.cdf(math.nan)) and d.cdf(-math.inf) == 0 and d.cdf(math.inf) == 1
    for lower, upper in ((0.5, 0.5), (0.9, 0.1), (-0.1, 0.5), (0.5, math.nan)):
        with pytest.raises(InvalidProbe):
            d.trimmed_mean(lower, upper)
    assert Digest.from_array(range(10)).trimmed_mean(0.1, 0.9) == 4.5


@pytest.mark.parametrize("values", [[1, math.nan], [math.inf], [-math.inf, 0], [None, 1.0]])
def test_training_values(values):
    with pytest.raises(InvalidTrainingData):
        Digest.from_array(values)
    with pytest.raises(InvalidTrainingData):
        Digest.from_array([1.0]).add(values)


def test_training_weights_and_overflow():
    d = Digest.from_array([1.0])
    for v, w in (([1, 2], [1]), ([1], [0]), ([1], [-1]), ([1], [math.nan])):
        with pytest.raises(InvalidTrainingData):
            d.add_weighted(v, w)
    with pytest.raises(InvalidTrainingData):
        Digest.from_array([1e300], precision="f32")


@pytest.mark.parametrize(
    "bad",
    [
        {"max_size": 9}, {"max_size": 20_001}, {"scale": "k9"}, {"singleton_policy": "edges"}, {"pin_per_side": 2}, {
            "singleton_policy": "edges", "pin_per_side": 0
        }, {"singleton_policy": "edges", "pin_per_side": 6, "max_size": 10},
        {"delta": 10, "max_size": 50}, {"delta": 10, "scale": "k2"}, {"delta": 10, "singleton_policy": "use"}, {
            "delta": -1
        }, {"delta": math.nan}, {"precision": "f16"},
    ],
)
def test_settings_are_checked(bad):
    with pytest.raises(DigestError):
        config(**bad)
    with pytest.raises(TypeError):
        config("ten")


# --- bytes -----------------------------------------------------------------------------


@pytest.mark.parametrize("precision", ["f32", "f64"])
@pytest.mark.parametrize("version", [1, 2, 3])
def test_wire_round_trip(version, precision):
    d = Digest.from_array(
        [-3, -1, 0, 0.25, 10, 11],
        max_size=128,
        scale="k3",
        singleton_policy="edges",
        pin_per_side=2,
        precision=precision,
    )
    if version > 1:
        d.add_weighted([1.5, 2.5], [2, 3.5])
    back = Digest.from_bytes(d.to_bytes(version))
    assert (back.means, back.weights, back.config) == (d.means, d.weights, d.config)
    assert (back.sum, back.min, back.max) == (d.sum, d.min, d.max) and (back.parts.atomic == d.parts.atomic).all()
    assert wire.wire_precision(d.to_bytes(version)) == precision


def test_wire_layout():
    raw = Digest.from_array([1.5], max_size=77).to_bytes()
    assert raw[:12] == b"TDIG" + bytes([3, 1, 64, 2, 2, 1, 0, 0]) and len(raw) == 64 + 17
    assert struct.unpack_from("<QdddQd", raw, 12) == (77, 1.0, 1.5, 1.5, 1, 1.5)
    old = Digest.from_array([1.5], max_size=77, precision="f32").to_bytes(1)
    assert old[:8] == b"TDIG" + bytes([1, 2, 1, 0]) and len(old) == 56 + 12


def test_wire_rejects():
    raw = Digest.from_array([1, 2, 3]).to_bytes()
    for i in (5, 20, 40, 61, 70, len(raw) - 1):
        with pytest.raises(DecodeError):
            wire.decode(raw[:i] + bytes([raw[i] ^ 0x40]) + raw[i + 1 :])
    for bad in (b"", b"TDIG", b"XXXX" + raw[4:], raw[:-1], raw + b"x", b"TDIG" + bytes([9]) + raw[5:]):
        with pytest.raises(DecodeError):
            wire.decode(bad)
    with pytest.raises(DecodeError, match="f64"):
        wire.decode(raw, "f32")
    with pytest.raises(DecodeError):
        wire.decode(None)
    with pytest.raises(DigestError, match="whole weights"):
        Digest.from_means_weights([1.0], [0.2]).to_bytes(1)
    with pytest.raises(DigestError):
        Digest.from_array([1]).to_bytes(4)


def test_wire_of_empty():
    for version in (1, 2, 3):
        back = Digest.from_bytes(Digest.from_array([], max_size=50).to_bytes(version))
        assert back.is_empty() and back.config.max_size == 50


def test_copies():
    d = Digest.from_array([1, 2, 2], max_size=20)
    for other in (copy.copy(d), copy.deepcopy(d), pickle.loads(pickle.dumps(d)), Digest.from_dict(d.to_dict())):
        assert other.means == d.means and other.config == d.config
        other.add(9)
        assert d.count == 3
    assert Digest.from_dict(Digest.from_array(range(9), delta=5).to_dict()).config.delta == 5
    with pytest.raises(ValueError, match="schema"):
        Digest.from_dict({})


# --- properties ------------------------------------------------------------------------

numbers = st.lists(st.floats(-1e6, 1e6, allow_nan=False, width=32), min_size=1, max_size=200)


@settings(max_examples=60, deadline=None)
@given(numbers, st.sampled_from(["quad", "k1", "k2", "k3"]), st.sampled_from([10, 50, 1000]))
def test_any_values(values, scale, size):
    d = Digest.from_array(values, max_size=size, scale=scale)
    assert d.count == len(values) and len(d) <= size
    q = d.quantile([0, 0.1, 0.5, 0.9, 1])
    assert q == sorted(q) and min(values) <= q[0] and q[-1] <= max(values)
    c = d.cdf(sorted(values))
    assert all(0 <= x <= 1 for x in c) and all(b >= a - 1e-12 for a, b in zip(c, c[1:], strict=False))
    assert Digest.from_bytes(d.to_bytes()).means == d.means


@settings(max_examples=40, deadline=None)
@given(numbers, numbers)
def test_merging_small_digests_is_building(a, b):
    merged = Digest.from_array(a).merge(Digest.from_array(b))
    built = Digest.from_array([*a, *b])
    assert merged.means == built.means and merged.weights == built.weights
