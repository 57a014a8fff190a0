"""Implausible readings, flagged per source relative to its normal behaviour.

A local-level Kalman filter with the source's own noise and drift forecasts each reading from those before it, and a second
one from those after it.  Readings whose standardised innovation is above a gate are withheld from the filter; if at
most three in a row are withheld before the source goes on as before, they are candidates, while a longer run is a lasting
shift at which the filter starts anew.  A candidate is a spike if its innovation, the smaller of the two directions, is
above the threshold that the tail of the source's own innovations sets.  Stretches over which the variance of the
innovations vanishes are stuck.

Sources are cut into time shards.  A filter's memory of its start fades with every reading, so a shard starts from a filter
run over at least RUN_IN readings of the shards before it, after which its state no longer depends on where it began.
All shards of a batch are filtered side by side, one step of numpy for the k-th reading of every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir
from .points import SHARD, SOURCE

#: Standardised innovation from which a reading is withheld from the filter.
GATE = 3.5
#: Most consecutive readings of a spike, and fewest of a stuck stretch.
SPIKE_RUN, STUCK_RUN = 3, 8
#: A reading at a shift is a spike of its own only if so many times further off the new level than the others there.
ALONE = 2.0
#: A source with a larger share of repeated neighbours (stuck stretches aside) repeats itself by nature.
REPEATS = 0.05
#: Innovations vanish below this share of the source's own innovation deviation.
VANISH = 1e-3
#: Readings from either side of a shard over which its filters are run in: the weight of a start is below 1e-31 then.
RUN_IN = 512
#: The tail beyond the 99th percentile is carried on exponentially from the 95th and 99th, to a share of 0.01 / TAIL.
TAIL = 1000.0
#: Innovations a source needs before its own tail sets the threshold, and the threshold with fewer.
LEAST, SHORT = 20, 12.0
#: Innovations and differences are counted in classes of this ratio.
CLASS = 1.03
#: Grid periods in a shard.
SHARD_SLOTS = 16_384
#: Readings that a task packs, and filters, at once (or one shard).
BUFFER_ROWS = 500_000

_ZERO = -(1 << 18)  # the class of differences of 0
_COUNTS = pa.list_(pa.struct([("part", pa.int32()), ("class", pa.int32()), ("n", pa.int64())]))
_PACKED = pa.schema([("metric_name", pa.string()), ("host", pa.string()), ("shard", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("ts", pa.large_binary()), ("v", pa.large_binary()), ("steps", _COUNTS)])
_PACKED_DDL = "metric_name string, host string, shard bigint, n bigint, low double, high double, ts binary, v binary, steps array<struct<part int, class int, n bigint>>"
_FLAGS = pa.list_(pa.struct([("ts_ms", pa.int64()), ("outside", pa.bool_()), ("stuck", pa.bool_()), ("score", pa.float64())]))
_SEEN = pa.schema([("metric_name", pa.string()), ("host", pa.string()), ("flags", _FLAGS), ("counts", _COUNTS)])
_SEEN_DDL = "metric_name string, host string, flags array<struct<ts_ms bigint, outside boolean, stuck boolean, score double>>, counts array<struct<part int, class int, n bigint>>"


def noise(d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(drift variance, noise variance) from (median, 90th percentile) of the absolute first and second differences, along the last axis."""

    def variance(d):
        d = np.asarray(d, float)
        s = np.where(d[..., 0] > 0, 1.4826 * d[..., 0], d[..., 1] / 1.645) ** 2
        return np.where(s > 0, s, 1e-12)

    a, b = variance(d1), variance(d2)
    return np.maximum(b - a, 0.02 * a), np.maximum(a - b / 2, 0.05 * a)


def innovations(x: np.ndarray, sizes: np.ndarray, drift: np.ndarray, obs: np.ndarray, gate: float = GATE) -> tuple[np.ndarray, np.ndarray]:
    """(standardised innovation, withheld) of each reading of the series laid end to end in x.

    withheld: in a run of at most SPIKE_RUN readings beyond the gate that the series did not stay at.  A run that the
    series ends in counts as well: it was not seen to stay there.
    """
    score, out = np.zeros(len(x)), np.zeros(len(x), bool)
    if not len(x):
        return score, out
    # readings by their place in their series, longest series first: those still running are the first ones of each step
    lanes = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[lanes] = np.arange(len(sizes))
    starts = np.cumsum(sizes) - sizes
    running = np.cumsum(np.bincount(sizes)[::-1])[::-1][1:]  # series longer than t
    begins = np.r_[0, np.cumsum(running)[:-1]]
    t = np.arange(len(x)) - np.repeat(starts, sizes)
    at = begins[t] + np.repeat(rank, sizes)
    values = np.empty(len(x))
    values[at] = x
    live = lanes[sizes[lanes] > 0]
    drift, obs = drift[live], obs[live]
    level = np.array([np.median(x[s : s + min(5, n)]) for s, n in zip(starts[live].tolist(), sizes[live].tolist(), strict=True)])
    var, held, kept, last = obs.copy(), np.zeros(len(live), np.int64), np.zeros((SPIKE_RUN + 1, len(live))), np.zeros(len(live))
    scores, beyond = np.empty(len(x)), np.empty(len(x), bool)
    begin = begins.tolist()
    for step, k in enumerate(running.tolist()):
        a = begin[step]
        now, v, h = values[a : a + k], var[:k], held[:k]
        v += drift[:k]
        e = now - level[:k]
        s = v + obs[:k]
        z = scores[a : a + k]
        np.divide(e, np.sqrt(s), out=z)
        off = np.abs(z) > gate
        if h.any():  # readings nearer to the held ones than to the level stay with them
            off |= (h > 0) & (np.abs(e) > np.abs(now - last[:k]))
        gain = v / s
        beyond[a : a + k] = off
        if off.any():
            gain[off] = 0.0
            i = np.flatnonzero(off)
            kept[h[i], i] = last[i] = now[i]
            h[i] += 1
            h *= off
            i = i[h[i] > SPIKE_RUN]
            if len(i):  # a lasting shift: the readings that were held are measured against the new level, which only one of them may be off
                level[i], v[i], h[i] = np.median(kept[:, i], axis=0), obs[i], 0
                again = (kept[:, i] - level[i]) / np.sqrt(v[i] + obs[i])
                least = np.sort(np.abs(again), axis=0)
                alone = (np.abs(again) == least[-1]) & (least[-1] > gate) & (least[-1] > ALONE * least[-2])
                for back in range(SPIKE_RUN + 1):
                    scores[begin[step - back] + i] = again[SPIKE_RUN - back]
                    beyond[begin[step - back] + i] = alone[SPIKE_RUN - back]
        else:
            h[:] = 0
        level[:k] += gain * e
        v -= gain * v
    return scores[at], beyond[at]


def withhold(v: np.ndarray, drift: float, obs: float, gate: float = GATE) -> np.ndarray:
    """innovations() of one series: True for the readings withheld."""
    return innovations(np.asarray(v, float), np.array([len(v)]), np.array([drift]), np.array([obs]), gate)[1]


def _runs(flag: np.ndarray, least: int) -> np.ndarray:
    """flag without its runs shorter than least."""
    edge = np.flatnonzero(np.r_[True, flag[1:] != flag[:-1]]) if len(flag) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[edge, len(flag)])
    return flag & np.repeat(sizes >= least, sizes)


def inspect_series(x: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, drift: np.ndarray, obs: np.ndarray):
    """(outside, stuck, candidate, score, pair, repeated) of each reading of the series laid end to end in x.

    score is NaN for readings outside the limits, which take no part in the filters, and for ordinary ones that only one filter knows.  pair: a reading and the one before it are
    not both stuck; repeated: and its innovation vanishes.
    """
    lane = np.repeat(np.arange(len(sizes)), sizes)
    outside = ~((x >= low[lane]) & (x <= high[lane]) & np.isfinite(x))
    # stuck: the innovations of a source that stays at its last reading vanish
    follows = np.r_[False, lane[1:] == lane[:-1]] if len(x) else np.zeros(0, bool)
    with np.errstate(invalid="ignore", over="ignore"):
        step = np.r_[0.0, np.diff(x)][: len(x)]
        repeated = follows & ((step * step <= VANISH**2 * (drift + 2 * obs)[lane]) | (np.r_[np.nan, x[:-1]][: len(x)] == x))
    late = _runs(repeated, STUCK_RUN - 1)
    stuck = late | np.r_[late[1:], False] if len(x) else late
    pair = follows & ~late
    inside = np.flatnonzero(~outside)
    part, own = x[inside], np.bincount(lane[inside], minlength=len(sizes))
    ahead, out_ahead = innovations(part, own, drift, obs)
    back, out_back = (r[::-1] for r in innovations(part[::-1], own[::-1], drift[::-1], obs[::-1]))
    # off to the same side of what comes before and of what comes after: steps between two levels are no spikes
    off = np.where(ahead * back > 0, np.minimum(np.abs(ahead), np.abs(back)), 0.0)
    # a filter knows nothing of a source when it starts: there the other direction decides alone, and has to be so much the surer
    place = np.arange(len(part)) - np.repeat(np.cumsum(own) - own, own)
    early, last = place < SPIKE_RUN, np.repeat(own, own) - place <= SPIKE_RUN
    both = early == last
    off = np.where(both, off, np.abs(np.where(early, back, ahead)))
    flag = np.where(both, out_ahead & out_back & (off > 0), np.where(early, out_back, out_ahead) & (off >= SHORT))
    # the readings of a spike stand and fall together, by the largest innovation of each direction
    begins = np.flatnonzero(flag & np.r_[True, ~flag[:-1] | (lane[inside][1:] != lane[inside][:-1])]) if len(flag) else np.zeros(0, np.int64)
    if len(begins):
        run = np.cumsum(np.bincount(begins, minlength=len(flag))) - 1
        known = ((ahead, both | last), (back, both | early))
        each = [np.maximum.reduceat(np.where(flag, np.where(valid, np.abs(z), np.inf), 0.0), begins) for z, valid in known]
        off[flag] = np.minimum(*each)[run[flag]]
    score, candidate = np.full(len(x), np.nan), np.zeros(len(x), bool)
    score[inside], candidate[inside] = np.where(both | flag, off, np.nan), flag
    return outside, stuck, candidate, score, pair, repeated & pair


def inspect(v: np.ndarray, low: float, high: float, d1: np.ndarray, d2: np.ndarray, body: slice):
    """inspect_series() of the body of one series, from the percentiles of its differences."""
    drift, obs = noise(d1, d2)
    one = lambda a: np.array([a], float)
    return tuple(a[body] for a in inspect_series(np.asarray(v, float), np.array([len(v)]), one(low), one(high), one(drift), one(obs)))


def _classes(value: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        c = np.floor(np.log(value) / np.log(CLASS))
    return np.where(value > 0, np.maximum(c, _ZERO + 1), _ZERO).astype(np.int64)


def _counted(lane: np.ndarray, part: np.ndarray, number: np.ndarray, lanes: int) -> pa.Array:
    """Per lane the list of (part, class, n)."""
    key, n = np.unique((lane * 2 + part) * (1 << 20) + (number + (1 << 19)), return_counts=True)
    group, c = key >> 20, (key & ((1 << 20) - 1)) - (1 << 19)
    rows = pa.StructArray.from_arrays([pa.array((group & 1).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], fields=list(_COUNTS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(group >> 1, np.arange(lanes + 1)).astype(np.int32)), rows)


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary per stretch of 8-byte values; starts ends with the number of values."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(points: pa.Table) -> pa.RecordBatch:
    """Points in order of shard and time, one row for each shard; with the counts of their first (part 0) and second (1) differences."""
    names = [points.column(c).combine_chunks().dictionary_encode() for c in SOURCE]
    by = [points.column("_place").to_numpy(), *(n.indices.to_numpy() for n in names), points.column("shard").to_numpy()]
    ts, v, low, high = (points.column(c).to_numpy() for c in ("ts_ms", "reading", "low", "high"))
    changes = lambda c: c[1:] != c[:-1]
    if (np.logical_or.reduce([changes(c) for c in by[1:]]) & ~changes(by[0])).any():  # two shards of one place
        order = np.lexsort((ts, *by[::-1]))
        by, (ts, v, low, high) = [c[order] for c in by], (c[order] for c in (ts, v, low, high))
    first = np.flatnonzero(np.r_[True, np.logical_or.reduce([changes(c) for c in by])])
    edges = np.r_[first, len(v)]
    lane = np.repeat(np.arange(len(first)), np.diff(edges))
    inside = (v >= low) & (v <= high) & np.isfinite(v)
    x, own = v[inside], lane[inside]
    with np.errstate(over="ignore"):
        d1, d2 = (np.minimum(np.abs(x[k:] - x[:-k]), np.finfo(float).max)[own[k:] == own[:-k]] for k in (1, 2))
    of = lambda k: own[k:][own[k:] == own[:-k]]
    steps = _counted(np.r_[of(1), of(2)], np.repeat([0, 1], [len(d1), len(d2)]), _classes(np.r_[d1, d2]), len(first))
    text = [n.dictionary.take(pa.array(c[first])).cast(pa.string()) for n, c in zip(names, by[1:3], strict=True)]
    return pa.RecordBatch.from_arrays([*text, pa.array(by[3][first]), pa.array(np.diff(edges)), pa.array(low[first]), pa.array(high[first]), _binary(ts, edges), _binary(v, edges), steps], schema=_PACKED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BUFFER_ROWS:
            whole = pa.Table.from_batches(held)
            place = whole.column("_place").to_numpy()
            end = int(np.searchsorted(-(place != place[-1]).astype(np.int8), 0))  # the last shard may go on
            if end:
                yield _packed(whole.slice(0, end))
            held = whole.slice(end).combine_chunks().to_batches()
            rows = whole.num_rows - end
    if rows:
        yield _packed(pa.Table.from_batches(held))


def _pieces(batches: Iterator[pa.RecordBatch], limit: int = BUFFER_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive shards with at most limit readings, or one."""
    for b in batches:
        total = np.cumsum(b.column("n").to_numpy())
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def _inspect_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches):
        get = lambda c: b.column(c).to_pylist()
        numbers = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        parts, sizes, begins, ends = [], [], [], []
        for v, around in zip(get("v"), get("around"), strict=True):
            near = sorted(around or [], key=lambda r: r["other"])
            before = np.frombuffer(b"".join(r["readings"] for r in near if r["before"]))[-RUN_IN:]
            behind = np.frombuffer(b"".join(r["readings"] for r in near if not r["before"]))[:RUN_IN]
            body = np.frombuffer(v)
            begins.append(sum(sizes) if not sizes else begins[-1] + sizes[-1])
            sizes.append(len(before) + len(body) + len(behind))
            parts += [before, body, behind]
            ends.append((len(before), len(body)))
        x, sizes = np.concatenate(parts), np.array(sizes)
        drift, obs = noise(*(np.array([q or (0.0, 0.0) for q in get(c)]) for c in ("d1", "d2")))
        outside, stuck, candidate, score, pair, repeated = inspect_series(x, sizes, numbers("low"), numbers("high"), drift, obs)
        own = np.concatenate([np.arange(at + n0, at + n0 + n) for at, (n0, n) in zip(begins, ends, strict=True)])
        lane = np.repeat(np.arange(len(sizes)), [n for _, n in ends])
        ts = np.frombuffer(b"".join(get("ts")), np.int64)
        outside, stuck, candidate, score, pair, repeated = (a[own] for a in (outside, stuck, candidate, score, pair, repeated))
        seen = np.flatnonzero(outside | stuck | candidate)
        rows = pa.StructArray.from_arrays([pa.array(ts[seen]), pa.array(outside[seen]), pa.array(stuck[seen]), pa.array(score[seen], mask=~candidate[seen])], fields=list(_FLAGS.value_type))
        flags = pa.ListArray.from_arrays(pa.array(np.searchsorted(lane[seen], np.arange(len(sizes) + 1)).astype(np.int32)), rows)
        normal = np.flatnonzero(~candidate & ~np.isnan(score))
        # part 0: innovations by class; part 1: pairs (class 0) and repeated ones among them (class 1)
        pairs, repeats = np.flatnonzero(pair), np.flatnonzero(repeated)
        counts = _counted(
            lane[np.r_[normal, pairs, repeats]], np.repeat([0, 1], [len(normal), len(pairs) + len(repeats)]),
            np.r_[_classes(np.maximum(score[normal], 1e-3)), np.zeros(len(pairs), np.int64), np.ones(len(repeats), np.int64)], len(sizes),
        )
        yield pa.RecordBatch.from_arrays([b.column("metric_name"), b.column("host"), flags, counts], schema=_SEEN)


def _shards(points: DataFrame) -> DataFrame:
    """One row for each shard, its readings in order of time as packed numbers."""
    limits = [F.coalesce("low_limit", F.lit(float("-inf"))).cast("double").alias("low"), F.coalesce("high_limit", F.lit(float("inf"))).cast("double").alias("high")]
    placed = points.select(*SHARD, "ts_ms", F.col("reading").cast("double").alias("reading"), *limits, F.xxhash64(*SHARD).alias("_place"))
    return placed.sortWithinPartitions("_place", "ts_ms").mapInArrow(_pack, _PACKED_DDL)


def _percentiles(part: int, probs: list[float]):
    """Percentiles of the numbers counted in a part's classes, read from the counts; each task sends one small map per source."""
    own = f"if(part = {part}, class, null)"
    return F.transform(F.expr(f"percentile({own}, array({', '.join(f'{p}D' for p in probs)}), n)"), lambda c: F.when(c <= _ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(CLASS), c + 0.5)))


def _around(shards: DataFrame) -> DataFrame:
    """(SHARD, around): the last readings of the shards before each and the first ones of those after it, RUN_IN at least where there are so many.

    Only numbers of readings are put in order per source, a row for each shard; readings travel between neighbours.
    """
    order = Window.partitionBy(*SOURCE)
    upto = shards.select(*SHARD, (F.sum("n").over(order.orderBy("shard")) - F.col("n")).alias("rank"))
    by_rank = order.orderBy("rank")
    near = F.collect_list("shard").over(by_rank.rangeBetween(-RUN_IN, -1))
    reaching = F.last("shard").over(by_rank.rangeBetween(Window.unboundedPreceding, -RUN_IN - 1))
    listed = upto.select(*SHARD, near.alias("near"), reaching.alias("reaching"))
    pairs = listed.select(*SHARD, F.explode(F.array_compact(F.concat(F.array("reaching"), "near"))).alias("earlier"))
    ends = shards.select(*SHARD, F.substring("v", 1, 8 * RUN_IN).alias("head"), F.substring("v", -8 * RUN_IN, 8 * RUN_IN).alias("tail"))
    tails = pairs.join(ends.select(*SOURCE, F.col("shard").alias("earlier"), "tail"), [*SOURCE, "earlier"])
    heads = pairs.join(ends.select(*SHARD, "head"), list(SHARD))
    piece = lambda other, before, c: F.struct(F.col(other).alias("other"), F.lit(before).alias("before"), F.col(c).alias("readings")).alias("piece")
    moved = tails.select(*SHARD, piece("earlier", True, "tail")).unionAll(heads.select(*SOURCE, F.col("earlier").alias("shard"), piece("shard", False, "head")))
    return moved.groupBy(*SHARD).agg(F.collect_list("piece").alias("around"))


def implausible(points: DataFrame) -> DataFrame:
    """(metric_name, host, ts_ms, outside, stuck, spike): the flagged readings, with the reasons.

    points: the result of sharded_points(limits=True).  outside: beyond low_limit or high_limit (null limits do not
    bind).  stuck: in a stretch of eight or more readings of vanishing innovations (equal ones above all) of a source that
    otherwise hardly repeats itself.  spike: one to three readings whose innovation is beyond the source's threshold; readings
    outside the limits take no part in it.  Sources with fewer than LEAST normal readings have the threshold SHORT.
    Infinite readings are outside any limit.  An empty input gives an empty result.
    """
    ensure_checkpoint_dir(points.sparkSession)
    shards = _shards(points).checkpoint()
    steps = shards.select(*SOURCE, F.inline("steps")).groupBy(*SOURCE).agg(_percentiles(0, [0.5, 0.9]).alias("d1"), _percentiles(1, [0.5, 0.9]).alias("d2"))
    # what a shard needs of its source is joined to its name, so that the readings move once
    named = shards.select(*SHARD).join(steps, list(SOURCE), "left")
    known = shards.drop("steps").join(named, list(SHARD)).join(_around(shards), list(SHARD), "left")
    seen = known.mapInArrow(_inspect_shards, _SEEN_DDL).checkpoint()
    counted = lambda part, c: F.sum(F.when((F.col("part") == part) & (F.col("class") == c), F.col("n")))
    habits = seen.select(*SOURCE, F.inline("counts")).groupBy(*SOURCE).agg(
        F.sum(F.when(F.col("part") == 0, F.col("n"))).alias("n_values"), _percentiles(0, [0.95, 0.99]).alias("q"), (counted(1, 1) / counted(1, 0)).alias("share")
    )
    q95, q99 = F.col("q")[0], F.col("q")[1]
    own = F.when(F.col("n_values") >= LEAST, F.greatest(F.lit(GATE), q99 + (q99 - q95) * float(np.log(TAIL) / np.log(5.0)))).otherwise(F.lit(SHORT))
    flags = seen.select(*SOURCE, F.inline("flags")).join(habits.select(*SOURCE, "share", own.alias("bound")), list(SOURCE), "left")
    stuck, spike = F.col("stuck") & (F.coalesce("share", F.lit(0.0)) <= REPEATS), F.coalesce(F.col("score") >= F.coalesce("bound", F.lit(SHORT)), F.lit(False))
    return flags.select(*SOURCE, "ts_ms", "outside", stuck.alias("stuck"), spike.alias("spike")).where("outside or stuck or spike")
