"""Helpers shared by the operators: safe broadcasts, exact integer time arithmetic, latest-write merging."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
#: A table joined by broadcast() must have been counted and found at or below this many rows.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast after counting it; a larger table is left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def floor_div(value: Column, size: Column | int) -> Column:
    """Integer floor division that is exact for 64-bit values and for negatives."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.call_function("div", value - F.pmod(value, size), size)


def present(value: Column) -> Column:
    """True where a floating value is neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def merge_latest(df: DataFrame, keys: Sequence[str], order: str, value: str, carry: Sequence[str] = ()) -> DataFrame:
    """Per key the non-null value (NaN counts as null) with the greatest order, and the carried columns of that row.

    Rows whose key, order or value is null take no part.  Rows with equal key and order: the one read last holds.
    The group is one logical cell, so no group grows with the data.
    """
    kept = df.where(present(col(value)))
    for k in (*keys, order):
        kept = kept.where(col(k).isNotNull())
    aggs = [F.max_by(col(c), col(order)).alias(c) for c in (value, *carry)]
    return kept.groupBy(*[col(k) for k in keys]).agg(*aggs)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir.  Where it is unset, a session of one machine (local master) gets a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "lodestrand-checkpoints"))


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """df with its rows numbered from start in their order, without one task for all: places within partitions plus the sizes of those before."""
    ensure_checkpoint_dir(df.sparkSession)
    held = df.withColumn("_place", F.monotonically_increasing_id()).checkpoint()  # written, so that both uses see the same places
    part = F.shiftright("_place", 33).alias("_part")
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))  # over one row for each partition
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = held.withColumn("_part", part).join(F.broadcast(first), "_part")
    return joined.withColumn(name, F.col("_first") + inside + F.lit(start)).drop("_place", "_part", "_first")
