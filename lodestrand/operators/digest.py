"""Percentiles of very large numeric columns by merging centroid digests, with a certified rank error.

Sorted values are clustered under a size function of the quantile (clusters are narrow at both ends); digests of
partitions, salts, days and finally of all days merge by clustering their centroids again.  A second pass over the
values counts how many lie below and at each estimate, so that the rank error of every estimate is known, not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Compression: a cluster at quantile q spans at most about 2*pi*sqrt(q*(1-q))/DELTA of the rank, 0.32 % at the median.
DELTA = 1000
#: Stated rank error of an estimate, as a share of the values.
RANK_ERROR = 0.005
#: Values buffered by a task before they are clustered.
BUFFER_ROWS = 1_000_000
#: Centroids that a task merges at once, in whole groups.
MERGE_ROWS = 2_000_000
#: Partial digests of a group merge in this many parts first, so that no task gets the digests of all partitions.
MERGE_PARTS = 32


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: float = DELTA):
    """Cluster weighted values group by group; returns (group, mean, weight) of the centroids, sorted."""
    if not len(mean):
        return group, mean, weight
    order = np.lexsort((mean, group))
    group, mean, weight = group[order], mean[order], weight[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    cum = np.cumsum(weight)
    before = np.repeat(np.r_[0.0, cum[starts[1:] - 1]], sizes)
    total = np.repeat(np.add.reduceat(weight, starts), sizes)
    q = np.clip((cum - before - weight / 2) / total, 0.0, 1.0)
    cell = np.floor(delta / (2 * np.pi) * (np.arcsin(2 * q - 1) + np.pi / 2))
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])])
    w = np.add.reduceat(weight, cut)
    # infinite values: inf * weight / weight stays infinite; a cluster holding both infinities has no mean and is kept at the middle
    with np.errstate(invalid="ignore"):
        m = np.add.reduceat(mean * weight, cut) / w
    single = np.diff(np.r_[cut, len(group)]) == 1
    m[single] = mean[cut[single]]
    return group[cut], np.nan_to_num(m, nan=0.0, posinf=np.inf, neginf=-np.inf), w


def quantiles(mean: np.ndarray, weight: np.ndarray, probs: Sequence[float]) -> np.ndarray:
    """Estimates from sorted centroids, linear between the middle ranks of neighbours."""
    middle = np.cumsum(weight) - weight / 2
    with np.errstate(invalid="ignore"):
        return np.interp(np.asarray(probs) * weight.sum(), middle, mean)


def _partial(keys: Sequence[str], value: str, out: pa.Schema, delta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % MERGE_PARTS
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush():
            whole, codes, names = _coded(held, keys)
            g, m, w = cluster(codes, whole[value].to_numpy(float), np.ones(len(whole)), delta)
            done = names.loc[g].reset_index(drop=True).assign(part=part, mean=m, weight=w)
            return pa.RecordBatch.from_pandas(done[out.names], schema=out, preserve_index=False)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BUFFER_ROWS:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _coded(batches: Sequence[pa.RecordBatch], keys: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame]:
    """(rows, number of each row's group, the keys by group number)."""
    whole = pa.Table.from_batches(batches).combine_chunks().to_pandas()
    codes = whole.groupby(list(keys), sort=True, dropna=False).ngroup().to_numpy()
    first = pd.Series(codes).drop_duplicates()
    return whole, codes, whole.loc[first.index, list(keys)].set_axis(first.to_numpy()).sort_index()


def _shrunk(held: Sequence[pa.RecordBatch], keys: Sequence[str], delta: float) -> pa.RecordBatch:
    """The centroids of the centroids held, in the same columns."""
    whole, codes, names = _coded(held, keys)
    g, m, w = cluster(codes, whole["mean"].to_numpy(float), whole["weight"].to_numpy(float), delta)
    return pa.RecordBatch.from_pandas(names.loc[g].reset_index(drop=True).assign(mean=m, weight=w)[held[0].schema.names], schema=held[0].schema, preserve_index=False)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], limit: int = MERGE_ROWS, delta: float = DELTA) -> Iterator[list[pa.RecordBatch]]:
    """Centroids sorted by keys in lists of at least limit rows that end where a group ends; a group of more rows is merged as it comes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            whole = pa.Table.from_batches(held)
            same = np.ones(rows, bool)
            for k in keys:  # rows of the last group, which may go on
                last = whole.column(k)[rows - 1]
                equal = pc.equal(whole.column(k), last) if last.is_valid else pc.is_null(whole.column(k))
                same &= pc.fill_null(equal, False).to_numpy(zero_copy_only=False)
            end = int(np.argmax(same))
            if end:
                yield whole.slice(0, end).to_batches()
                held, rows = whole.slice(end).combine_chunks().to_batches(), rows - end
            else:
                held = [_shrunk(held, keys, delta)]
                rows = held[0].num_rows
    if rows:
        yield held


def _merge(keys: Sequence[str], out: pa.Schema, delta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, keys, delta=delta):
            yield _shrunk(held, keys, delta).select(out.names).cast(out)

    return run


def _estimate(keys: Sequence[str], probs: Sequence[float], out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, keys):
            whole, codes, names = _coded(held, keys)
            mean, weight = whole["mean"].to_numpy(float), whole["weight"].to_numpy(float)
            order = np.lexsort((mean, codes))
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            n, found = [], []
            for rows in np.split(order, cuts):
                n.append(int(round(weight[rows].sum())))
                found.append(quantiles(mean[rows], weight[rows], probs))
            done = names.reset_index(drop=True).assign(n_values=n, found=found)
            done.columns = out.names
            yield pa.RecordBatch.from_pandas(done, schema=out, preserve_index=False)

    return run


def _arrow(schema_text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema_text))


def _placed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the rows of a group in one partition, one after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def digest(df: DataFrame, keys: Sequence[str], value: str, delta: float = DELTA) -> DataFrame:
    """(keys..., mean, weight): the centroids of each group.  Null and NaN values take no part; null keys form a group.

    Values are clustered where they lie, and only centroids are shuffled, first in MERGE_PARTS parts of each group.
    """
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    shape = f"{types}, part int, mean double, weight double"
    kept = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    partial = kept.mapInArrow(_partial(keys, value, _arrow(shape), delta), shape)
    parts = _placed(partial, [*keys, "part"]).mapInArrow(_merge([*keys, "part"], _arrow(shape), delta), shape)
    return merge_digests(parts, keys, delta)


def merge_digests(digests: DataFrame, keys: Sequence[str], delta: float = DELTA) -> DataFrame:
    """Merge the centroids of finer groups into those of coarser ones, such as days into the whole."""
    types = ", ".join(f"`{k}` {digests.schema[k].dataType.simpleString()}" for k in keys)
    shape = f"{types}, mean double, weight double"
    return _placed(digests.select(*keys, "mean", "weight"), keys).mapInArrow(_merge(keys, _arrow(shape), delta), shape)


def digest_percentiles(digests: DataFrame, keys: Sequence[str], probs: Sequence[float], name: str = "estimates") -> DataFrame:
    """(keys..., n_values, estimates array<double> in the order of probs)."""
    types = ", ".join(f"`{k}` {digests.schema[k].dataType.simpleString()}" for k in keys)
    shape = f"{types}, n_values bigint, `{name}` array<double>"
    return _placed(digests.select(*keys, "mean", "weight"), keys).mapInArrow(_estimate(keys, probs, _arrow(shape)), shape)


def count_ranks(df: DataFrame, keys: Sequence[str], value: str, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The second pass.  bounds has one row of double columns per key; adds n, below_C and upto_C for each column C."""
    counts = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        counts += [F.count_if(F.col(value) < F.col(c)).alias(f"below_{c}"), F.count_if(F.col(value) <= F.col(c)).alias(f"upto_{c}")]
    kept = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.join(bounds.select(*keys, *columns), list(keys)).groupBy(*keys, *columns).agg(*counts)


def rank_error(prob: float, column: str):
    """Share of the values by which the estimate misses its rank; 0 if the wanted rank lies within its ties."""
    low, high, at = F.col(f"below_{column}") / F.col("n"), F.col(f"upto_{column}") / F.col("n"), F.lit(float(prob))
    return F.greatest(F.lit(0.0), low - at, at - high)
