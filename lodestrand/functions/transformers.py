"""Common transformers of jobs as native operations on a whole result, in the order of its rows.

Each takes and gives a DataFrame whose first column is the key.  None is one task's work: positions come from numbered(), the
rest are aggregates, filters and limits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators.common import col, numbered

_AT = "_at"


def _numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _plain(df: DataFrame, c: str):
    """A numeric column with NaN as null."""
    return F.when(~F.isnan(col(c)), col(c)) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col(c)


def distinct(df: DataFrame) -> DataFrame:
    """One row for each combination of values; of repeated ones that with the least key."""
    key, *values = df.columns
    return df.groupBy(*[col(c) for c in values]).agg(F.min(col(key)).alias(key)).select(*[col(c) for c in df.columns])


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def bottom(df: DataFrame, n: int = 1) -> DataFrame:
    """The last n rows."""
    placed = numbered(df, _AT)
    end = placed.agg(F.max(_AT).alias("_end"))
    return placed.crossJoin(F.broadcast(end)).where(F.col(_AT) > F.col("_end") - n).drop(_AT, "_end")  # end is one row


def sort_index(df: DataFrame) -> DataFrame:
    """The rows from the greatest key to the least."""
    return df.orderBy(col(df.columns[0]).desc())


def mean(df: DataFrame) -> DataFrame:
    """One row: the average of each numeric column, the key included."""
    return df.agg(*[F.avg(_plain(df, c)).alias(c) for c in _numbers(df)])


def skew(df: DataFrame) -> DataFrame:
    """One row: the unbiased sample skewness of each numeric column, null for fewer than three values."""
    out = []
    for c in _numbers(df):
        x, n = _plain(df, c), F.count(_plain(df, c)).cast("double")
        out.append(F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).alias(c))
    return df.agg(*out)


def spread(df: DataFrame) -> DataFrame:
    """One row: how many rows after its first least value the first greatest value of each numeric column stands."""
    placed = numbered(df, _AT)

    def distance(c: str):
        x = _plain(df, c)
        top = F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), (-F.col(_AT)).alias("at"))))
        low = F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), F.col(_AT).alias("at"))))
        return (-top["at"] - low["at"]).alias(c)

    return placed.agg(*[distance(c) for c in _numbers(df)])


def keep_columns(names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """The named columns that there are."""
    return lambda df: df.select(*[col(c) for c in names if c in df.columns])


def row_at(position: int) -> Callable[[DataFrame], DataFrame]:
    """The row at a position, counted from 0."""
    return lambda df: numbered(df, _AT).where(F.col(_AT) == position).drop(_AT)


def between_time(start_ns: int, end_ns: int) -> Callable[[DataFrame], DataFrame]:
    """The rows whose key lies between two times of the day (ns since midnight UTC, both included; start > end goes over midnight)."""
    day = 86_400_000_000_000

    def run(df: DataFrame) -> DataFrame:
        at = F.pmod(col(df.columns[0]), F.lit(day))
        return df.where((at >= start_ns) & (at <= end_ns) if start_ns <= end_ns else (at >= start_ns) | (at <= end_ns))

    return run


NATIVE = {"distinct": distinct, "head": head, "bottom": bottom, "sortindex": sort_index, "mean": mean, "skew": skew, "spread": spread}
