"""The system aggregates as native Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.operators.common import col
from lodestrand.plans.errors import StatementError

SET_TO_ROW = ("min", "max", "sum", "avg", "count", "first_value", "last_value")
SET_TO_SET = ("first", "last")
LEVEL_FUNCTIONS = ("sum", "count", "avg")


def aggregate(func: str, name: str, kind: str, key: str = "key") -> Column:
    """One aggregate of a series.  On no values sum and count are 0, avg is NaN and the others null."""
    c = col(name)
    if func in ("sum", "avg") and kind in ("BINARY", "BOOLEAN"):
        raise StatementError(f"{func} needs numbers, {name} holds {kind}")
    if func == "count":
        return F.count(c)
    if func == "sum":
        return F.coalesce(F.sum(c), F.lit(0).cast("bigint" if kind in ("INTEGER", "LONG") else "double"))
    if func == "avg":
        return F.coalesce(F.avg(c), F.lit(float("nan")))
    if func in ("min", "max"):
        return (F.min if func == "min" else F.max)(c)
    if func in ("first_value", "last_value"):
        # a null ordering value keeps a null reading out
        by = F.when(c.isNotNull(), F.col(key))
        return (F.min_by if func == "first_value" else F.max_by)(c, by)
    raise StatementError(f"unknown function {func}")
