"""Relational operators over keyed series: windows, aggregates, levels, first and last points, joins, arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.aggregates import LEVEL_FUNCTIONS
from lodestrand.plans.errors import StatementError

from .common import col

BUCKET = "_bucket"


def tumbling(df: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """df within [start, end) with the begin of each row's window as _bucket; integer arithmetic, no shuffle."""
    kept = df.where((F.col("key") >= start) & (F.col("key") < end))
    return kept.withColumn(BUCKET, F.col("key") - F.pmod(F.col("key") - F.lit(start), F.lit(width)))


def hopping(df: DataFrame, start: int, end: int, width: int, slide: int) -> DataFrame:
    """df within [start, end), each row once for every window start + i*slide that holds it; windows may leave gaps."""
    if slide <= 0:
        raise StatementError("a window needs a positive slide")
    count = max(1, -(-(end - 1 - start - width + 1) // slide) + 1)
    place = F.col("key") - F.lit(start)
    low = F.greatest(F.lit(0).cast("long"), F.call_function("div", place - F.lit(width) + F.lit(slide), F.lit(slide).cast("long")))
    low = F.when(place < width, F.lit(0).cast("long")).otherwise(low)
    high = F.least(F.lit(count - 1).cast("long"), F.call_function("div", place, F.lit(slide).cast("long")))
    kept = df.where((F.col("key") >= start) & (F.col("key") < end)).where(low <= high)
    return kept.withColumn(BUCKET, F.explode(F.sequence(low, high))).withColumn(BUCKET, F.lit(start) + F.col(BUCKET) * F.lit(slide))


def downsample(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """One row per window that holds a row, keyed by its begin; all aggregates in one pass."""
    return df.groupBy(BUCKET).agg(*[c.alias(n) for n, c in aggs.items()]).withColumnRenamed(BUCKET, "key")


def level_path(path: str, levels: Sequence[int]) -> str:
    return ".".join(node if i in levels else "*" for i, node in enumerate(path.split(".")))


def level_total(func: str, names: Sequence[str], piece: Callable[[str, str], Column]) -> Column:
    """sum, count or avg over the values of several series from their own aggregates, which piece(function, series) gives: sums of sums, never means of means."""
    if func not in LEVEL_FUNCTIONS:
        raise StatementError("only sum, count and avg can be grouped by level")
    total = lambda f: sum((piece(f, n) for n in names[1:]), piece(f, names[0]))
    if func != "avg":
        return total(func)
    n = total("count")
    return F.when(n == 0, F.lit(float("nan"))).otherwise(total("sum") / F.greatest(n, F.lit(1)))


def end_points(df: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, path, value) of the first or last non-null point of each (func, series), value as text."""
    if not wanted:
        return df.sparkSession.createDataFrame([], "key bigint, path string, value string")
    # one pass over the data: an aggregate per series, unfolded afterwards
    aggs = []
    for func, n in wanted:
        by = F.when(col(n).isNotNull(), F.col("key"))
        point = F.struct(F.min(by).alias("key"), F.lit(n).alias("path"), F.min_by(col(n), by).cast("string").alias("value"))
        if func == "last":
            point = F.struct(F.max(by).alias("key"), F.lit(n).alias("path"), F.max_by(col(n), by).cast("string").alias("value"))
        aggs.append(point)
    return df.agg(F.array(*aggs).alias("p")).select(F.inline("p")).where("key is not null")


def keyless(df: DataFrame, prefix: str) -> DataFrame:
    """One side of a join: the key becomes the plain column prefix.key."""
    return df.withColumnRenamed("key", f"{prefix}.key") if "key" in df.columns else df


def join(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str, how: str, on: Column | None = None, using: Sequence[str] | None = None, natural: bool = False) -> DataFrame:
    """Join two keyless sides.  using (and natural) columns are kept once: the left copy, for a right join the right one.

    Null join values match nothing; numbers of different types are compared as wider numbers.
    """
    if how == "cross":
        return left.crossJoin(right)
    if natural:
        strip = lambda names, p: {n[len(p) + 1 :]: n for n in names if n.startswith(p + ".") and n != f"{p}.key"}
        ours, theirs = strip(left.columns, left_prefix), strip(right.columns, right_prefix)
        using = sorted(set(ours) & set(theirs))
        if not using:
            raise StatementError("a natural join needs columns of one name on both sides")
    drop: list[str] = []
    if using:
        on = F.lit(True)
        for u in using:
            a, b = f"{left_prefix}.{u}", f"{right_prefix}.{u}"
            if a not in left.columns or b not in right.columns:
                raise StatementError(f"no column {u} on both sides of the join")
            text = isinstance(left.schema[a].dataType, T.StringType), isinstance(right.schema[b].dataType, T.StringType)
            on = on & ((col(a) == col(b)) if text[0] == text[1] else F.lit(False))
            drop.append(a if how == "right" else b)
    joined = left.join(right, on, how)
    return joined.select(*[col(c) for c in joined.columns if c not in drop])


_SIGNS = {"+": "+", "-": "-", "*": "×", "/": "÷", "%": "%"}


def arithmetic(expr, resolve) -> tuple[Column, str, str]:
    """(column, type, name) of an arithmetic expression; resolve gives (column, type, name) of a path or call.

    Equal types keep their type, mixed ones become DOUBLE; whole numbers divide without rest; doubles follow IEEE.
    """
    op = expr[0]
    if op == "const":
        kind = "LONG" if isinstance(expr[1], int) else "DOUBLE"
        return F.lit(expr[1]).cast("bigint" if kind == "LONG" else "double"), kind, str(expr[1])
    if op in ("path", "call"):
        return resolve(expr)
    if op == "group":
        c, kind, name = arithmetic(expr[1], resolve)
        return c, kind, f"({name})"
    if op in ("neg", "pos"):
        c, kind, name = arithmetic(expr[1], resolve)
        return (-c if op == "neg" else c), kind, ("- " if op == "neg" else "+ ") + name
    _, sign, left, right = expr
    (a, ka, na), (b, kb, nb) = arithmetic(left, resolve), arithmetic(right, resolve)
    if "BINARY" in (ka, kb) or "BOOLEAN" in (ka, kb):
        raise StatementError("arithmetic needs numbers")
    kind = ka if ka == kb else "DOUBLE"
    if kind == "DOUBLE":
        a, b = a.cast("double"), b.cast("double")
    whole = kind in ("INTEGER", "LONG")
    if sign == "+":
        out = a + b
    elif sign == "-":
        out = a - b
    elif sign == "*":
        out = a * b
    elif sign == "/":
        out = F.call_function("div", a, b) if whole else F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.try_divide(a, b))
    else:
        out = a % b if whole else F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.try_mod(a, b))
    return (out.cast("int") if kind == "INTEGER" else out), kind, f"{na} {_SIGNS[sign]} {nb}"
