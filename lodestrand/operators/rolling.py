"""Totals and averages over trailing periods of days, days without activity included.

Each daily total is exploded onto every output date it influences, the copies are grouped by entity and date, and
calendar rows between an entity's first and last active day are joined in for the zeros.  After the daily
pre-aggregation an entity has at most one row a day, so moving its days to one place is safe for hot entities too, and
the explosion and its aggregation then run without another shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col

#: name -> (first, last) day before the output date that the period takes in; 0 is the output date itself.
TRAILING = {"7": (6, 0), "30": (29, 0)}


def daily_totals(df: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """(entity, day, total, n): pre-aggregated on the map side.  Null entities, days and values take no part."""
    kept = df.where(col(entity).isNotNull() & col(day).isNotNull() & col(value).isNotNull())
    return kept.groupBy(col(entity).alias("entity"), col(day).cast("int").alias("day")).agg(F.sum(col(value)).alias("total"), F.count(F.lit(1)).alias("n"))


def trailing_totals(daily: DataFrame, periods: Mapping[str, tuple[int, int]] = TRAILING) -> DataFrame:
    """(entity, day, total_P, n_P, avg_P ...) for each day from an entity's first to its last active day.

    daily: the result of daily_totals.  total_P is 0 and n_P is 0 where the period holds no value; avg_P is the total
    divided by the days of the period (days without activity count), mean_P the total divided by the values (null
    if there are none).  An empty input gives an empty result.
    """
    reach = max(first for first, _ in periods.values())
    placed = daily.repartition("entity")
    age = F.col("date") - F.col("day")
    last = placed.withColumn("last_day", F.max("day").over(Window.partitionBy("entity")))
    onto = last.select("entity", "day", "total", "n", F.explode(F.sequence("day", F.least(F.col("day") + reach, F.col("last_day")))).alias("date"))
    # the calendar's branch reads totals and numbers as well, so that it shares the shuffle of the other
    filled = F.sum(F.when(F.col("total").isNotNull(), F.col("n")))
    span = placed.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), filled.alias("filled")).where("filled > 0")
    sums = []
    for name, (first, last) in periods.items():
        inside = age.between(last, first)
        sums += [F.sum(F.when(inside, F.col(c)).otherwise(F.lit(0).cast(daily.schema[c].dataType))).alias(f"{c}_{name}") for c in ("total", "n")]
    rolled = onto.groupBy("entity", "date").agg(*sums)
    calendar = span.select("entity", F.explode(F.sequence("first_day", "last_day")).alias("date"))
    full = calendar.join(rolled, ["entity", "date"], "left")
    out = [F.col("entity"), F.col("date").alias("day")]
    for name, (first, last) in periods.items():
        total, n = F.coalesce(F.col(f"total_{name}"), F.lit(0).cast(daily.schema["total"].dataType)), F.coalesce(F.col(f"n_{name}"), F.lit(0))
        out += [total.alias(f"total_{name}"), n.alias(f"n_{name}"), (total / F.lit(float(first - last + 1))).alias(f"avg_{name}"), F.when(n > 0, total / n).alias(f"mean_{name}")]
    return full.select(*out)
