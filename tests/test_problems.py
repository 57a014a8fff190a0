"""The general operators on small fixtures: nulls, ties, empty inputs, and brute-force versions."""

import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute_times import brute_instant
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.operators import digest as D
from lodestrand.operators import drift as S
from lodestrand.operators import grid as G
from lodestrand.operators import rolling as R
from lodestrand.operators import spikes as K
from lodestrand.operators import timestamps as T
from lodestrand.operators.points import sharded_points
from lodestrand.operators.records import holding_values, record_cells

BATCHES = "batch_id bigint, metric_name string, tags map<string,string>, datapoints array<struct<ts_ms bigint, reading double>>, clash int"
CATALOG = "metric_name string, step_s int, low_limit double, high_limit double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rolling_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(f"e{e}", int(d), float(rng.integers(-5, 9))) for e in range(4) for d in sorted(rng.choice(120, 25))] + [("e0", None, 1.0), (None, 3, 1.0), ("e1", 5, None)]
    daily = R.daily_totals(spark.createDataFrame(data, "entity string, day int, value double"), "entity", "day", "value")
    got = {(r["entity"], r["day"]): r for r in R.trailing_totals(daily).collect()}
    by = defaultdict(lambda: defaultdict(list))
    for e, d, v in data:
        if None not in (e, d, v):
            by[e][d].append(v)
    assert set(got) == {(e, d) for e, ds in by.items() for d in range(min(ds), max(ds) + 1)}
    for (e, d), r in got.items():
        for name, n in (("7", 7), ("30", 30)):
            inside = [v for k in range(d - n + 1, d + 1) for v in by[e].get(k, [])]
            assert r[f"total_{name}"] == sum(inside) and r[f"n_{name}"] == len(inside) and r[f"avg_{name}"] == sum(inside) / n
            assert r[f"mean_{name}"] == (sum(inside) / len(inside) if inside else None)


def test_rolling_of_nothing(spark):
    empty = spark.createDataFrame([], "entity string, day int, value double")
    assert R.trailing_totals(R.daily_totals(empty, "entity", "day", "value")).count() == 0


def test_record_merging(spark):
    shape = "record_id bigint, rec_key bigint, measurements array<string>, data_types array<string>, vals array<double>, series string"
    data = [
        (1, 10, ["d.s1", "d.s2"], ["LONG", "LONG"], [1.0, 2.0], "x"), (2, 10, ["d.s1", "d.s2"], ["LONG", "LONG"], [None, float("nan")], "x"),
        (3, 10, ["d.s2"], ["LONG"], [7.0], "x"), (4, -1, ["d.s1"], ["LONG"], [9.0], "x"), (5, None, ["d.s1"], ["LONG"], [9.0], "x"), (6, 11, None, None, None, "x"),
    ]
    assert rows(holding_values(record_cells(spark.createDataFrame(data, shape)))) == [("d.s1", 10, 1.0), ("d.s2", 10, 7.0)]


def test_digest_rank_error_and_merging():
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([rng.lognormal(0, 2, 60_000), np.full(20_000, 3.0)]))
    g, m, w = D.cluster(np.zeros(len(values), int), values, np.ones(len(values)))
    parts = [D.cluster(np.zeros(len(p), int), p, np.ones(len(p))) for p in np.array_split(rng.permutation(values), 40)]
    _, m2, w2 = D.cluster(np.zeros(sum(len(p[1]) for p in parts), int), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    for mean, weight in ((m, w), (m2, w2)):
        assert weight.sum() == len(values) and len(mean) <= D.DELTA + 1
        for p, q in zip((0.01, 0.5, 0.9, 0.999), D.quantiles(mean, weight, (0.01, 0.5, 0.9, 0.999)), strict=True):
            low, high = np.searchsorted(values, q, "left") / len(values), np.searchsorted(values, q, "right") / len(values)
            assert max(0, low - p, p - high) <= D.RANK_ERROR


def test_digest_counting_pass(spark):
    df = spark.createDataFrame([("a", float(i % 100)) for i in range(1000)] + [("b", None), ("b", float("nan")), (None, 5.0), ("c", float("inf")), ("c", 1.0)], "k string, v double")
    est = D.digest_percentiles(D.digest(df, ["k"], "v"), ["k"], (0.5,))
    got = {r["k"]: (r["n_values"], r["estimates"][0]) for r in est.collect()}
    assert got["a"][0] == 1000 and abs(got["a"][1] - 49.5) <= 1 and got[None] == (1, 5.0) and "b" not in got and got["c"][0] == 2
    bounds = est.selectExpr("k", "estimates[0] as bound")
    counted = {r["k"]: r for r in D.count_ranks(df, ["k"], "v", bounds, ["bound"]).collect()}
    assert counted["a"]["n"] == 1000 and abs(counted["a"]["below_bound"] - 500) <= 10
    assert D.digest(df.limit(0), ["k"], "v").count() == 0


def test_timestamps_match_an_independent_reader(spark, data):
    raw, feeds = spark.read.parquet(f"{data}/raw_points.parquet"), spark.read.parquet(f"{data}/feeds.parquet")
    got = {r["raw_id"]: r["rec_key"] for r in T.normalise_points(raw, feeds).collect()}
    zones = {r["feed_id"]: (r["zone_name"], r["day_order"]) for r in pq.read_table(f"{data}/feeds.parquet").to_pylist()}
    for r in pq.read_table(f"{data}/raw_points.parquet").to_pylist():
        assert got.get(r["raw_id"]) == brute_instant(r["time_text"], *zones.get(r["feed_id"], (None, "ymd"))), r


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2024-10-27 02:30:00", "Europe/Berlin", "ymd", 1729989000), ("2024-10-27 02:30:00 CET", "Europe/Berlin", "ymd", 1729992600), ("2024-03-31 02:30:00", "Europe/Berlin", "ymd", None),
        ("03/04/2024 01:02", "UTC", "dmy", 1712106120), ("03/04/2024 01:02", "UTC", "mdy", 1709514120), ("03/04/2024 01:02", "UTC", None, None), ("2024-02-30 00:00:00Z", None, None, None),
        ("2024-04-07 01:45:00", "Australia/Lord_Howe", "ymd", 1712414700), ("1700000000.5", None, None, 1700000000.5), ("2024-01-01 00:00:00", "No/Where", "ymd", None), ("2024-01-01 00:00:00 [Foo/Bar]", "UTC", "ymd", None), ("2024-01-01 00:00:00 America/New_York", None, "ymd", 1704085200), ("-1", None, None, None), ("", "UTC", None, None), (None, "UTC", None, None), ("x" * 50_000, "UTC", None, None),
    ],
)
def test_single_timestamps(spark, text, zone, order, want):
    df = spark.createDataFrame([(text, zone, order, 1)], "t string, z string, o string, rec_key int")
    got = T.parse_instants(df, "t", "z", "o").collect()[0]["rec_key"]
    assert got == (None if want is None else int(want * 10**9))


def test_offsets_are_inferred(spark):
    # a clock two hours east that changes to one hour east on day 10, ingested within twenty minutes
    data = [("f", d * 86400 + h * 3600 + (7200 if d < 10 else 3600), d * 86400 + h * 3600 + 60 * (h % 20)) for d in range(20) for h in range(24)] + [("f", None, 1), (None, 1, 1)]
    df = spark.createDataFrame(data, "s string, local bigint, ref bigint")
    found = T.infer_offsets(df, "s", "local", "ref", max_lag_s=1800)
    assert {r["period"]: r["offset_s"] for r in found.collect() if r["period"] not in (10, 20)} == {d: 7200 if d < 10 else 3600 for d in range(20) if d != 10}
    ok = [r for r in T.apply_offsets(df, "s", "local", found).collect() if r["utc_s"] is not None]
    assert len(ok) == 480 and sum(0 <= r["ref"] - r["utc_s"] < 1800 for r in ok) >= 455
    assert T.infer_offsets(df.limit(0), "s", "local", "ref").count() == 0


def points(spark, batches, limits=False, slots=4):
    return sharded_points(spark.createDataFrame(batches, BATCHES), spark.createDataFrame([("m", 10, 0.0, 100.0), ("n", 10, None, None), ("m", 10, 0.0, 100.0)], CATALOG), slots, limits)


def test_grid_fills_across_shards(spark):
    inf, nan = float("inf"), float("nan")
    batches = [
        (1, "m", {"host": "h"}, [(1_000, 1.0), (11_000, 2.0), (12_000, 3.0), (95_000, 5.0)], 1), (2, "m", {"host": "h"}, [(95_000, 6.0), (11_000, None), (12_000, nan), (-15_000, inf)], 1),
        (3, "m", {}, [(50_000, 1.0)], 1), (4, "m", None, [(50_000, 1.0)], 1), (5, "zz", {"host": "h"}, [(0, 1.0)], 1), (6, "m", {"host": "one"}, [(0, 1.0)], 1), (7, "m", {"host": "none"}, [(0, None)], 1), (8, "m", {"host": "h"}, None, 1),
    ]
    got = {(r["host"], r["slot_s"]): r for r in G.regular_grid(points(spark, batches)).collect()}
    assert set(got) == {("h", s) for s in range(-20, 91, 10)} | {("one", 0)}
    assert [s for (h, s), r in sorted(got.items()) if r["is_missing"]] == [-10, 20, 30, 40, 50, 60, 70, 80]
    assert got["h", 10]["reading"] == 3.0 and got["h", 10]["n_readings"] == 2 and got["h", 90]["reading"] == 6.0
    assert got["h", 50]["carried"] == 3.0 and math.isclose(got["h", 50]["interpolated"], 3.0 + 3.0 / 2) and got["h", -10]["interpolated"] is None
    missing = {(r["host"], r["slot_s"]) for r in G.regular_grid(points(spark, batches), missing_only=True).collect()}
    assert missing == {k for k, r in got.items() if r["is_missing"]}
    assert G.regular_grid(points(spark, batches).limit(0)).count() == 0


def test_long_gaps_are_cut_into_blocks(spark):
    n = 3 * G.BLOCK + 5
    assert G.regular_grid(points(spark, [(1, "m", {"host": "h"}, [(0, 1.0), (n * 10_000, 1.0)], 1)]), missing_only=True).count() == n - 1


def test_spikes_stuck_and_limits(spark):
    rng = np.random.default_rng(5)
    v = 50 + rng.normal(0, 1, 900)
    v[400:] += 20  # a lasting shift is no case
    v[100], v[200:203], v[600:620] = 65.0, 35.0, 71.0
    v[300] = 150.0
    batches = [(i, "m", {"host": "h"}, [(k * 10_000, float(v[k])) for k in range(i * 30, i * 30 + 30)], 1) for i in range(30)]
    batches += [(99, "n", {"host": "few"}, [(0, 1.0), (10_000, float("inf"))], 1)]
    got = K.implausible(points(spark, batches, True, 128)).collect()
    by = lambda c: {r["ts_ms"] // 10_000 for r in got if r[c] and r["metric_name"] == "m"}
    assert by("outside") == {300} and by("stuck") == set(range(600, 620)) and by("spike") == {100, 200, 201, 202}
    # sharded and whole agree
    whole = K.implausible(points(spark, batches, True, 100_000))
    assert rows(whole) == sorted((tuple(r) for r in got), key=repr)
    assert K.implausible(points(spark, batches, True).limit(0)).count() == 0


def test_filter_withholds_only_short_runs():
    v = np.r_[np.zeros(50), 9.0, np.zeros(50), np.full(50, 9.0)] + np.sin(np.arange(151)) * 0.1
    assert list(np.flatnonzero(K.withhold(v, 0.001, 0.01))) == [50]


HEADERS = "file_id bigint, dataset string, seq_no int, col_names array<string>, col_types array<string>"
CELLS = "file_id bigint, row_no int, rec_key bigint, cells array<string>"


def drift_tables(spark):
    heads = [
        (1, "d", 1, ["a", "b", "c"], ["INTEGER", "DOUBLE", "BOOLEAN"]), (2, "d", 2, None, None), (3, "d", 3, ["x", "b", "C2"], ["BIGINT", "DOUBLE", "BOOLEAN"]), (4, "d", 3, ["zzz"], ["INT32"]),
        (5, "d", 2000, ["b", "x"], ["DOUBLE", "INT64"]), (6, "e", 1, ["q", None, "q"], ["INT32", "INT32", "INT64"]),
    ]
    cells = [(1, 1, 5, ["9", "9.5", "t"]), (1, 2, 6, ["1", "2.5", "t"]), (1, 3, 7, ["2", None, "f"]), (3, 1, 6, ["1.0", "2.5", "t"]), (3, 2, 7, ["2", None, "f"]), (3, 3, 8, ["3", "1", "f"]), (5, 1, 7, ["1", "2"]), (5, 2, 8, None)]
    return spark.createDataFrame(heads, HEADERS), spark.createDataFrame(cells, CELLS)


def test_column_changes(spark):
    got = rows(S.column_changes(*drift_tables(spark)))
    assert got == sorted([(3, "renamed", "a", "x"), (3, "retyped", "a", "x"), (3, "removed", "c", ""), (3, "added", "", "C2"), (5, "removed", "C2", "")], key=repr)
    heads, cells = drift_tables(spark)
    assert S.column_changes(heads.limit(0), cells).count() == 0 and S.column_changes(heads, cells.limit(0)).where("change = 'renamed'").count() == 0


def test_unified_table(spark):
    got = {(r["file_id"], r["row_no"], r["column"]): (r["col_type"], r["cell"]) for r in S.unify(*drift_tables(spark)).collect()}
    assert got[1, 1, "x"] == ("INT64", "9") and got[3, 1, "x"] == ("INT64", "1.0") and got[1, 3, "b"] == ("DOUBLE", None) and got[1, 1, "c"] == ("BOOLEAN", "t")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_matching_is_best(n, m, data):
    from itertools import permutations

    w = [[data.draw(st.sampled_from([0.0, 0.5, 1.0, 1.25])) for _ in range(m)] for _ in range(n)]
    total = sum(w[i][j] for i, j in S.best_matching(w))
    size = max(n, m)
    best = max(sum(w[i][p[i]] for i in range(n) if p[i] < m) for p in permutations(range(size)))
    assert math.isclose(total, best)


def test_entry_without_text_subpackage():
    import __spark_entry__ as e

    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_renames_without_shared_keys(spark):
    rng = np.random.default_rng(12)
    towns = ["Oslo", "Bergen", "Bodo", "Tromso"]

    def cells(file_id, first, names):
        n = 200
        made = {"temperature": rng.normal(20, 3, n), "pressure": rng.normal(1013, 8, n), "town": rng.choice(towns, n), "serial": rng.integers(0, 10**9, n), "flag": rng.choice(["t", "f"], n)}
        return [(file_id, k + 1, first + k, [None if k % 50 == 7 else str(made[c][k]) for c in names]) for k in range(n)]

    order = ["temperature", "pressure", "town", "serial", "flag"]
    heads = [(1, "d", 1, order, ["DOUBLE", "DOUBLE", "BYTE_ARRAY", "INT64", "BOOLEAN"]), (2, "d", 2, ["place_town", "temp", "press_hpa", "note", "flag2"], ["VARCHAR", "FLOAT", "DOUBLE", "VARCHAR", "BOOLEAN"])]
    data = cells(1, 0, order) + [(f, r, k, [c[2], c[0], c[1], "".join(rng.choice(list("abcdefgh"), int(rng.integers(20, 90)))), c[4]]) for f, r, k, c in cells(2, 1000, order)]
    got = rows(S.column_changes(spark.createDataFrame(heads, HEADERS), spark.createDataFrame(data, CELLS)))
    want = [(2, "renamed", "temperature", "temp"), (2, "renamed", "pressure", "press_hpa"), (2, "renamed", "town", "place_town"), (2, "retyped", "temperature", "temp"), (2, "removed", "serial", ""), (2, "added", "", "note"), (2, "removed", "flag", ""), (2, "added", "", "flag2")]
    assert got == sorted(want, key=repr)


def test_sketches_merge(spark):
    data = [(1, k, k, [str(k % 7), None if k % 2 else f"v{k}"]) for k in range(100)]
    wanted = spark.createDataFrame([(1, [0, 1, 5])], "file_id bigint, positions array<int>")
    one, many = (S.column_sketches(spark.createDataFrame(data, CELLS).repartition(n), wanted).collect() for n in (1, 7))
    assert len(one) == len(many) == 2
    for a, b in zip(sorted(one), sorted(many), strict=True):
        assert a["sketch"]["least"] == b["sketch"]["least"] and a["sketch"]["n"] == b["sketch"]["n"] and math.isclose(a["sketch"]["size"], b["sketch"]["size"])


def test_following_links(spark):
    rng = np.random.default_rng(13)
    items = [("d" if k % 3 else "e", f"n{rng.integers(3)}", int(rng.integers(-3000, 6000)), k) for k in range(300)]
    links = sorted({("d" if k % 2 else "e", f"n{rng.integers(3)}", int(rng.integers(-3000, 6000))) for k in range(25)} | {items[0][:3]})
    got = S.following(spark.createDataFrame(items, "dataset string, name string, place bigint, k int"), spark.createDataFrame([(*x, (x[2],)) for x in links], "dataset string, name string, place bigint, link struct<at bigint>"))
    want = {k: min((x[2] for x in links if x[:2] == (d, n) and x[2] > p), default=None) for d, n, p, k in items}
    assert {r["k"]: r["found"] and r["found"]["at"] for r in got.collect()} == want


def test_large_groups_are_merged_as_they_come():
    import pyarrow as pa

    rng = np.random.default_rng(14)
    values = {"a": rng.normal(0, 1, 50_000), None: rng.normal(5, 1, 300), "z": rng.exponential(1, 20_000)}
    batches = [pa.record_batch({"k": pa.array([k] * len(p), pa.string()), "mean": pa.array(p), "weight": pa.array(np.ones(len(p)))}) for k, v in values.items() for p in np.array_split(v, 9)]
    lists = list(D._whole_groups(iter(batches), ["k"], limit=4000))
    assert all(sum(b.num_rows for b in held) < 12_000 for held in lists)
    rows = pa.Table.from_batches([b for held in lists for b in held]).to_pandas()
    for k, v in values.items():
        own = rows[rows.k.isna() if k is None else rows.k == k].sort_values("mean")
        assert own.weight.sum() == len(v)
        for q in (0.1, 0.5, 0.95):
            found = D.quantiles(own["mean"].to_numpy(), own["weight"].to_numpy(), [q])[0]
            assert abs((v <= found).mean() - q) <= max(D.RANK_ERROR, 1 / len(v))
