"""Curve matching: the place in a set of series whose shape pattern is nearest to a query curve's, under banded time warping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.plans.errors import StatementError

from .common import col, floor_div

#: Start points of a series that one task compares.
STARTS = 4096
#: Widest warping band.
BAND = 256
#: Changes below which a curve counts as level, and as straight.
SLOPE, CONCAVITY = 0.1, 0.05
#: Resampled values held at once.
HELD = 1 << 20


def shape_pattern(x: np.ndarray, slope: float = SLOPE, concavity: float = CONCAVITY) -> np.ndarray:
    """Along the last axis, a number for each step: its amplitude times a code for how the curve goes on after it.

    The code has the sign of the next step's slope and is 0 where that is level, as after the last step.  Its size is 3
    where the curve turns or steepens, 2 where it goes straight on and 1 where it flattens.
    """
    now = np.diff(x)
    after = np.concatenate([now[..., 1:], np.zeros_like(now[..., :1])], axis=-1)
    bend = after - now
    down = np.where(now < -slope, np.select([bend < -concavity, bend > concavity], [-3.0, -1.0], -2.0), -3.0)
    up = np.where(now > slope, np.select([bend < -concavity, bend > concavity], [1.0, 3.0], 2.0), 3.0)
    return np.abs(now) * np.where(after < -slope, down, np.where(after > slope, up, 0.0))


def normalise(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=-1, keepdims=True)
    return np.where(s == 0, 0.0, (x - x.mean(axis=-1, keepdims=True)) / np.where(s == 0, 1.0, s))


def warping_distances(query: np.ndarray, curves: np.ndarray, band: int) -> np.ndarray:
    """Squared-error dynamic time warping of each row of curves to the query, by the reference's recurrence.

    Row i of it ends before i + band, but the cell above is read there as well: from the third row on it is one that
    was never set, and counts as 0.
    """
    n, c = len(query), curves.T
    edge = min(band, n - 1) + 1
    row = np.zeros((n, c.shape[1]))
    row[:edge] = np.cumsum((query[0] - c[:edge]) ** 2, axis=0)
    first = np.cumsum((query[:edge, None] - c[0]) ** 2, axis=0)
    for i in range(1, n):
        new = np.zeros_like(row)
        if i < edge:
            new[0] = first[i]
        for j in range(max(1, i - band), min(n, i + band)):
            reach = np.minimum(row[j - 1], row[j])
            if j + band != i:
                reach = np.minimum(reach, new[j - 1])
            new[j] = reach + (query[i] - c[j]) ** 2
        row = new
    return row[n - 1]


def best_start(keys: np.ndarray, values: np.ndarray, starts: np.ndarray, query: np.ndarray, unit: int) -> tuple[float, int]:
    """(distance, start key) of the nearest resampled stretch; the smallest key wins ties."""
    size = len(query)
    target = normalise(shape_pattern(query))
    band = min(BAND, -(-len(target) // 4))
    starts = np.sort(starts)
    starts = starts[starts + unit * (size - 1) <= keys[-1]]
    found = (np.inf, -1)
    step = max(1, HELD // size)
    with np.errstate(invalid="ignore"):  # infinite readings
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None] + unit * np.arange(size)
            d = warping_distances(target, normalise(shape_pattern(np.interp(at, keys, values))), band)
            d = np.where(np.isnan(d), np.inf, d)
            best = int(d.argmin())
            if d[best] < found[0]:
                found = (float(d[best]), int(starts[k + best]))
    return found


def curve_match(df: DataFrame, names: Sequence[str], query: Sequence[float], unit: int, start: int, end: int) -> DataFrame:
    """(path, key, distance) of the best match among the series of df in [start, end); ties go to the smallest (path, key).

    A series is cut into blocks of start points, each with the points its last stretch needs, across gaps of any length, so
    a long series is shared among tasks.  Series without a full stretch give no match, and an empty input gives an empty result.
    """
    if len(query) < 2:
        raise StatementError("a curve needs two points at least")
    wanted, span = np.asarray(query, float), unit * (len(query) - 1)
    block = max(unit * STARTS, 2 * span + 1)
    points = df.where((F.col("key") >= start) & (F.col("key") < end)).select("key", F.explode(F.array(*[F.struct(F.lit(n).alias("path"), col(n).cast("double").alias("value")) for n in names])).alias("p"))
    long = points.select("key", "p.*").where("value is not null")
    own = floor_div(F.col("key") - F.lit(start), block)
    # a point serves its own block and, as run-out, the one before it
    placed = long.withColumn("_own", own)
    spread = placed.withColumn("_block", F.explode(F.array("_own", F.col("_own") - 1)))
    # and the first point after these two blocks, however far: a stretch that runs into a gap ends on the line to it
    heads = placed.groupBy("path", "_own").agg(F.min("key").alias("key"), F.min_by("value", "key").alias("value"))
    scan = Window.partitionBy("path").orderBy("_own")  # over one row for each block
    ahead = lambda n: F.lead(F.struct("_own", "key", "value"), n).over(scan)
    later = heads.select("path", F.col("_own").alias("_block"), ahead(1).alias("_one"), ahead(2).alias("_two"))
    later = later.withColumn("_next", F.when(F.col("_one._own") > F.col("_block") + 1, F.col("_one")).otherwise(F.col("_two"))).where("_next is not null")
    spread = spread.unionByName(later.select("_next.key", "path", "_next.value", "_next._own", "_block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        keys, values = pdf["key"].to_numpy(), pdf["value"].to_numpy()
        d, k = best_start(keys, values, keys[(pdf["_own"] == pdf["_block"]).to_numpy()], wanted, unit)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "key": [k], "distance": [d]})

    # no distance: no stretch of the block is full
    each = spread.groupBy("path", "_block").applyInPandas(run, "path string, key bigint, distance double").where("distance < double('infinity')")
    return each.orderBy("distance", "path", "key").limit(1)
