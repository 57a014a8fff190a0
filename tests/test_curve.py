"""Curve matching against a plain transcription of the reference, with linear resampling."""

import math

import numpy as np
import pytest

from lodestrand.operators import curve as C


def pattern(x):
    out = []
    for i in range(len(x) - 1):
        now, after = x[i + 1] - x[i], 0.0 if i == len(x) - 2 else x[i + 2] - x[i + 1]
        code = 0.0
        if after < -0.1:
            code = -3.0 if now >= -0.1 or after - now < -0.05 else -1.0 if after - now > 0.05 else -2.0
        elif after > 0.1:
            code = 3.0 if now <= 0.1 or after - now > 0.05 else 1.0 if after - now < -0.05 else 2.0
        out.append(abs(now) * code)
    return out


def norm(x):
    mean = sum(x) / len(x)
    std = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
    return [0.0 if std == 0 else (v - mean) / std for v in x]


def distance(q, s, w):
    n, dis = len(q), np.zeros((256, 256))
    dis[0][0] = (q[0] - s[0]) ** 2
    for i in range(1, w + 1):
        dis[0][i] = dis[0][i - 1] + (q[0] - s[i]) ** 2
        dis[i][0] = dis[i - 1][0] + (q[i] - s[0]) ** 2
    for i in range(1, n):
        for j in range(max(1, i - w), min(n, i + w)):
            dis[i][j] = dis[i - 1][j - 1]
            if i + w != j:
                dis[i][j] = min(dis[i][j], dis[i - 1][j])
            if j + w != i:
                dis[i][j] = min(dis[i][j], dis[i][j - 1])
            dis[i][j] += (q[i] - s[j]) ** 2
    return dis[n - 1][n - 1]


def brute(keys, values, query, unit):
    target, best = norm(pattern(query)), (math.inf, -1)
    for start in keys:
        at = [start + unit * k for k in range(len(query))]
        if at[-1] <= keys[-1]:
            d = distance(target, norm(pattern(list(np.interp(at, keys, values)))), math.ceil(len(target) / 4))
            best = min(best, (d, int(start)))
    return best


@pytest.mark.parametrize("size", [3, 5, 10, 18, 33])
def test_distances_are_those_of_the_reference(size):
    rng = np.random.default_rng(size)
    query, curves = np.cumsum(rng.normal(0, 0.2, size)), np.cumsum(rng.normal(0, 0.2, (40, size)), axis=1)
    q, c = C.normalise(C.shape_pattern(query)), C.normalise(C.shape_pattern(curves))
    assert np.allclose(q, norm(pattern(list(query)))) and all(np.allclose(a, norm(pattern(list(b)))) for a, b in zip(c, curves, strict=True))
    band = math.ceil(len(q) / 4)
    assert np.allclose(C.warping_distances(q, c, band), [distance(list(q), list(s), band) for s in c])


def test_match_is_the_reference_s(spark):
    rng = np.random.default_rng(8)
    keys, values = np.arange(600) * 10, np.round(np.cumsum(rng.normal(0, 1, 600)), 2)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values, strict=True)], "key bigint, a double")
    query = [1.0, 2.0, 4.0, 8.0, 4.0, 2.0, 1.0, 2.0, 4.0, 8.0]
    got = C.curve_match(df, ["a"], query, 7, 0, 10**6).collect()[0]
    d, key = brute(keys, values, query, 7)
    assert got["key"] == key and math.isclose(got["distance"], d, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("gaps", [(30,), (10, 5_000), (9, 4_096, 20_000), (6_000, 6_000)])
def test_match_across_gaps_longer_than_a_block(spark, gaps):
    """The query is cut from the stretch that ends in a gap, so that only a line across the gap finds it."""
    rng = np.random.default_rng(len(gaps))
    parts, at = [], 0
    for gap in (*gaps, 0):
        parts.append(np.arange(at, at + 40))
        at += 40 + gap
    keys = np.concatenate(parts)
    values = np.round(rng.normal(0, 3, len(keys)), 2)
    for part in parts[1:]:
        values[keys == part[0]] = 4000.0 * (1 + len(gaps))  # a steep line across the gap
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values, strict=True)], "key bigint, a double")
    for part in parts[:-1]:
        query = list(np.interp(part[-1] - 6 + np.arange(10), keys, values))
        got = C.curve_match(df, ["a"], query, 1, 0, 10**9).collect()[0]
        d, key = brute(keys, values, query, 1)
        assert got["key"] == key == part[-1] - 6 and math.isclose(got["distance"], d, abs_tol=1e-9)


def test_matches_at_negative_keys(spark):
    values = [0.0] * 40 + [1, 5, 9, 5, 1] + [0.0] * 40
    df = spark.createDataFrame([((i - 60) * 10, float(v)) for i, v in enumerate(values)], "key bigint, a double")
    assert C.curve_match(df, ["a"], [1, 5, 9, 5, 1], 10, -(10**6), 10**6).collect()[0]["key"] == -200
