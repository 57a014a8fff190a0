"""Implausible readings where limits are missing and where sources are short or end."""

import numpy as np
from test_problems import points

from lodestrand.operators import spikes as K


def flagged(spark, values, slots=128, metric="n"):
    """Places flagged as (outside, spike), of readings ten seconds apart; limits of n are null, those of m 0 and 100."""
    batches = [(i, metric, {"host": "h"}, [(k * 10_000, float(values[k])) for k in range(i, min(i + 30, len(values)))], 1) for i in range(0, len(values), 30)]
    got = K.implausible(points(spark, batches, True, slots)).collect()
    return tuple({r["ts_ms"] // 10_000 for r in got if r[c]} for c in ("outside", "spike"))


def test_null_limits_do_not_bind(spark):
    v = 50 + np.random.default_rng(6).normal(0, 1, 900)
    v[100], v[200:203] = 75.0, 20.0
    assert flagged(spark, v) == (set(), {100, 200, 201, 202})
    v[300], v[500] = np.inf, -np.inf
    assert flagged(spark, v) == ({300, 500}, {100, 200, 201, 202})


def test_infinite_readings_are_outside_any_limit():
    v = np.r_[np.arange(30) % 3, np.inf, np.arange(30) % 4, -np.inf]
    outside = K.inspect(v, -np.inf, np.inf, np.ones(2), np.ones(2), slice(0, len(v)))[0]
    assert list(np.flatnonzero(outside)) == [30, 61]


def test_spikes_at_the_end_of_a_source(spark):
    v = 50 + np.random.default_rng(7).normal(0, 1, 300)
    v[298:] = 80.0
    for slots in (128, 100_000):
        assert flagged(spark, v, slots, "m") == (set(), {298, 299})
    # four readings are a lasting shift
    v[296:] = 80.0
    assert flagged(spark, v, metric="m") == (set(), set())


def test_spikes_of_short_sources(spark):
    v = 50 + np.random.default_rng(8).normal(0, 1, 16)
    assert flagged(spark, v) == (set(), set())
    v[7] = 90.0
    assert flagged(spark, v) == (set(), {7})
    v[15] = 10.0
    assert flagged(spark, v) == (set(), {7, 15})
    assert flagged(spark, v[:2]) == flagged(spark, [50.0] * 5) == (set(), set())


def test_stuck_with_a_little_jitter(spark):
    rng = np.random.default_rng(9)
    v = 50 + rng.normal(0, 1, 600)
    v[200:240] = 50 + rng.normal(0, 1e-6, 40)
    v[400:407] = 50.0  # seven are too few
    batches = [(i, "m", {"host": "h"}, [(k * 10_000, float(v[k])) for k in range(i, i + 30)], 1) for i in range(0, 600, 30)]
    got = K.implausible(points(spark, batches, True, 64)).collect()
    assert {r["ts_ms"] // 10_000 for r in got if r["stuck"]} == set(range(200, 240)) and not any(r["spike"] for r in got)


def test_flags_do_not_depend_on_shards(spark):
    rng = np.random.default_rng(10)
    v = 50 + np.cumsum(rng.normal(0, 0.05, 3000)) + rng.normal(0, 1, 3000)
    v[rng.choice(3000, 25, replace=False)] += 15
    v[1000:] += 12
    v[2000:2012] = v[2000]
    keep = np.sort(rng.choice(3000, 2500, replace=False))  # and gaps, so that some shards are nearly empty
    keep = keep[(keep < 300) | (keep > 420)]
    batches = [(int(i), "n", {"host": "h"}, [(int(k) * 10_000, float(v[k])) for k in keep[i : i + 50]], 1) for i in range(0, len(keep), 50)]
    got = [sorted(map(tuple, K.implausible(points(spark, batches, True, slots)).collect())) for slots in (3, 50, 700, 100_000)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) >= 25


def test_filters_side_by_side_are_filters_one_by_one():
    rng = np.random.default_rng(11)
    series = [rng.normal(0, 1, n) + 20 * (rng.random(n) < 0.02) + np.where(np.arange(n) > 60, 30, 0) for n in (0, 1, 4, 100, 250)]
    sizes = np.array([len(s) for s in series])
    drift, obs = rng.uniform(0.01, 0.5, 5), rng.uniform(0.5, 2, 5)
    z, out = K.innovations(np.concatenate(series), sizes, drift, obs)
    at = 0
    for s, q, r in zip(series, drift, obs, strict=True):
        want = one_by_one(s, q, r)
        np.testing.assert_allclose(z[at : at + len(s)], want[0])
        assert list(out[at : at + len(s)]) == list(want[1])
        at += len(s)


def one_by_one(v, drift, obs):
    z, out, held = np.zeros(len(v)), np.zeros(len(v), bool), []
    level, var = (np.median(v[:5]) if len(v) else 0.0), obs
    for i, x in enumerate(v):
        var += drift
        z[i] = (x - level) / np.sqrt(var + obs)
        if abs(z[i]) > K.GATE or (held and abs(x - level) > abs(x - v[held[-1]])):
            held.append(i)
            out[i] = True
            if len(held) > K.SPIKE_RUN:
                level, var = np.median(v[held]), obs
                z[held] = (v[held] - level) / np.sqrt(2 * obs)
                out[held] = [abs(z[k]) > max(K.GATE, *(K.ALONE * abs(z[j]) for j in held if j != k)) for k in held]
                held = []
            continue
        held = []
        gain = var / (var + obs)
        level, var = level + gain * (x - level), var * (1 - gain)
    return z, out


def test_pieces_hold_every_shard_once():
    import pyarrow as pa

    b = pa.record_batch({"n": pa.array([5, 3, 20, 1, 1, 9]), "i": pa.array(range(6))})
    parts = list(K._pieces([b.slice(0, 0), b], 9))
    assert [p.column("i").to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5]]
