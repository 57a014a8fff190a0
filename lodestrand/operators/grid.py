"""Irregular readings onto a regular grid.

Time-sharded: each shard is summarised by its first and last reading, the summaries are scanned in order per source so
that every shard knows the first reading after it, and then all shards are filled independently: a reading yields
its own slot and the missing slots up to the next reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import floor_div
from .points import SHARD, SOURCE

#: Missing slots generated from one row at a time; longer gaps are cut into blocks.
BLOCK = 4096


def slot_readings(points: DataFrame) -> DataFrame:
    """The last reading of each slot and the number of readings in it.  slot_s: begin in seconds since 1970."""
    step = F.col("step_s").cast("long")
    slotted = points.withColumn("slot_s", floor_div(F.col("ts_ms"), step * 1000) * step)
    return slotted.groupBy(*SHARD, "step_s", "slot_s").agg(F.max_by("reading", "ts_ms").alias("reading"), F.count(F.lit(1)).alias("n_readings"))


def regular_grid(points: DataFrame, missing_only: bool = False) -> DataFrame:
    """(metric_name, host, slot_s, step_s, reading, n_readings, is_missing, carried, interpolated) for every slot.

    points: the result of sharded_points.  Slots run from a source's first to its last one with a reading.  reading
    is null in a missing slot; carried is the last reading at or before the slot, interpolated is linear between the
    neighbouring readings (null next to infinite readings).  Infinite readings are readings.  A source with one
    reading has one slot.  missing_only leaves out the slots with a reading.
    """
    slots = slot_readings(points)
    inside = Window.partitionBy(*SHARD).orderBy("slot_s")
    ahead = slots.withColumns({"next_slot": F.lead("slot_s").over(inside), "next_reading": F.lead("reading").over(inside)})
    shards = slots.groupBy(*SHARD).agg(F.min("slot_s").alias("first_slot"), F.min_by("reading", "slot_s").alias("first_reading"))
    scan = Window.partitionBy(*SOURCE).orderBy("shard")
    carry = shards.select(*SHARD, F.lead("first_slot").over(scan).alias("carry_slot"), F.lead("first_reading").over(scan).alias("carry_reading"))
    step = F.col("step_s").cast("long")
    open_ended = F.col("next_slot").isNull()
    filled = ahead.join(carry, list(SHARD)).select(
        *SOURCE, "step_s", "slot_s", "reading", "n_readings",
        F.when(open_ended, F.col("carry_slot")).otherwise(F.col("next_slot")).alias("next_slot"),
        F.when(open_ended, F.col("carry_reading")).otherwise(F.col("next_reading")).alias("next_reading"),
    )
    # places after the reading: 0 is its own slot
    last = F.coalesce(F.call_function("div", F.col("next_slot") - F.col("slot_s"), step) - 1, F.lit(0))
    first = F.lit(1 if missing_only else 0)
    runs = filled.withColumn("last_place", last)
    if missing_only:
        runs = runs.where("last_place > 0")
    blocks = runs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("last_place"), F.lit(BLOCK).cast("long")))))
    low, high = F.greatest(first.cast("long"), F.col("block") * BLOCK), F.least(F.col("last_place"), F.col("block") * BLOCK + (BLOCK - 1))
    placed = blocks.where(low <= high).withColumn("place", F.explode(F.sequence(low, high)))
    gap = (F.col("next_slot") - F.col("slot_s")).cast("double")
    line = F.col("reading") + (F.col("next_reading") - F.col("reading")) * (F.col("place") * step).cast("double") / gap
    missing = F.col("place") > 0
    return placed.select(
        *SOURCE, (F.col("slot_s") + F.col("place") * step).alias("slot_s"), "step_s",
        F.when(~missing, F.col("reading")).alias("reading"), F.when(~missing, F.col("n_readings")).otherwise(F.lit(0).cast("long")).alias("n_readings"),
        missing.alias("is_missing"), F.col("reading").alias("carried"),
        F.when(~missing, F.col("reading")).when(~F.isnan(line) & (F.abs(line) < F.lit(float("inf"))), line).alias("interpolated"),
    )
