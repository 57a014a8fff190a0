"""Points of posted metrics and their time shards: the common ground of gridding and of spike detection.

A shard is a stretch of a source's time of fixed length, so no shard grows with the data, however hot its source.
Raw points are shuffled once, by source and shard; all later steps on them keep that placement.  What a shard needs
of its neighbours comes from small shard summaries, scanned in order per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, floor_div, present

SOURCE = ("metric_name", "host")
SHARD = (*SOURCE, "shard")
#: Grid periods in a shard.
SHARD_SLOTS = 2048


def sharded_points(batches: DataFrame, catalog: DataFrame, shard_slots: int = SHARD_SLOTS, limits: bool = False) -> DataFrame:
    """(metric_name, host, shard, step_s, [low_limit, high_limit,] ts_ms, reading), placed by (metric_name, host, shard).

    Per (source, ts_ms) the non-null reading of the greatest batch_id holds; NaN counts as null; batches without a
    host or a metric in the catalog do not count.
    """
    known = catalog.select("metric_name", "step_s", *(("low_limit", "high_limit") if limits else ())).where("step_s > 0").dropDuplicates(["metric_name"])
    posted = (
        batches.select("batch_id", "metric_name", F.col("tags")["host"].alias("host"), "datapoints")
        .where("host is not null and metric_name is not null and batch_id is not null")
        .select("batch_id", "metric_name", "host", F.inline("datapoints"))
        .where(present(F.col("reading")) & F.col("ts_ms").isNotNull())
    )
    rest = [c for c in known.columns if c != "metric_name"]
    placed = (
        posted.join(broadcast_if_small(known), "metric_name")
        .withColumn("shard", floor_div(F.col("ts_ms"), F.col("step_s").cast("long") * 1000 * shard_slots))
        .where("shard is not null")  # never; said here, each branch of a plan filters alike and shares the shuffle
        .repartition(*SHARD)
    )
    return placed.groupBy(*SHARD, *rest, "ts_ms").agg(F.max_by("reading", "batch_id").alias("reading"))
