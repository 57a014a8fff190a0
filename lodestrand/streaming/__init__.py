"""Ingest of JSON messages [{path, timestamp, dataType, value}] by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.common import col
from lodestrand.plans.errors import StatementError

MESSAGE = "array<struct<path string, timestamp bigint, dataType string, value string>>"


def read_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, key, kind, value): one row per point; messages that cannot be read give none."""
    each = lines.select(F.explode(F.from_json(F.col(column), MESSAGE)).alias("m")).select("m.path", F.col("m.timestamp").alias("key"), F.upper("m.dataType").alias("kind"), "m.value")
    return each.where("path is not null and key is not null and value is not null")


def ingest_stream(points: DataFrame, folder: str, checkpoint: str):
    """Append the points of a streaming DataFrame to a table partitioned by kind; a batch that is run again is written once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # the path is fixed by the batch number, so a repeated batch replaces itself
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/batch={batch_id}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_series(spark, folder: str, paths: list[str], kind: str) -> DataFrame:
    """The ingested points of the paths as a keyed wide table; of equal (path, key) the later batch holds."""
    types = {"LONG": "bigint", "INTEGER": "int", "FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean"}
    points = spark.read.parquet(folder).where((F.col("kind") == kind) & F.col("path").isin(*paths))
    held = points.groupBy("path", "key").agg(F.max_by("value", "batch").alias("value"))
    return held.groupBy("key").pivot("path", paths).agg(F.first(F.col("value").try_cast(types.get(kind, "string"))))


def register_points(catalog, points: DataFrame, kinds: dict[str, str]) -> None:
    """Add the points of read_messages to a catalog as series of the stated kinds; a point of another kind than its series is dropped.

    Whole numbers of both widths and numbers with a fraction do not mix: the kind has to be the same.  Values that the kind cannot hold are dropped; of equal (path, key) one holds.
    """
    types = {"LONG": "bigint", "INTEGER": "int", "FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean"}
    paths = sorted(kinds)
    for p in paths:
        if catalog.types.get(p, kinds[p]) != kinds[p]:
            raise StatementError(f"series {p} holds {catalog.types[p]}, not {kinds[p]}")
    fits = F.lit(False)
    for p in paths:
        fits = fits | ((F.col("path") == p) & (F.col("kind") == kinds[p]))
    held = points.where(fits).groupBy("key").pivot("path", paths).agg(F.max("value"))
    catalog.add(held.select("key", *[col(p).try_cast(types.get(kinds[p], "string")).alias(p) for p in paths]))
