"""Metric aggregators over (key, value) points of one metric, metric ingest and metric queries as dictionaries.

Each aggregator runs on the raw metric on its own.  Neighbour operations (diff, rate, sampler) range-partition the metric by
key and carry the last point of each partition into the next, and percentiles range-partition the counted values, so
that neither a long metric nor a hot bucket is one task's work, however its keys and values are spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.timeutil import PRECISION_NS
from lodestrand.plans.catalog import full_name, split_name
from lodestrand.plans.errors import StatementError

from .common import col, ensure_checkpoint_dir
from .series import BUCKET, tumbling

# A month of relative times has 28 days, a year 336.
REST_UNIT_MS = {"millis": 1, "seconds": 1_000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000, "weeks": 604_800_000, "months": 2_419_200_000, "years": 29_030_400_000}


def first_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(key, value): the first non-null column of each row, in order of full names."""
    return df.select("key", F.coalesce(*[col(n) for n in sorted(names)]).alias("value")).where("value is not null")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_previous(points: DataFrame) -> DataFrame:
    """(key, value, previous_key, previous): each point with the one before it; the first has nulls.  Points of one key follow each other in any order."""
    ensure_checkpoint_dir(points.sparkSession)
    # written with the number of the range, so that the points and the ends of ranges agree on it
    cut = points.select("key", "value").repartitionByRange(_parts(points), "key").withColumn("_range", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy("_range").orderBy("key", "value")
    near = cut.withColumns({"previous_key": F.lag("key").over(own), "previous": F.lag("value").over(own)})
    ends = cut.groupBy("_range").agg(F.max(F.struct("key", "value")).alias("end"))
    before = F.lag("end").over(Window.orderBy("_range"))  # over one row for each range
    joined = near.join(F.broadcast(ends.select("_range", before.alias("_before"))), "_range")
    first = F.col("previous_key").isNull()
    return joined.select("key", "value", F.when(first, F.col("_before.key")).otherwise(F.col("previous_key")).alias("previous_key"), F.when(first, F.col("_before.value")).otherwise(F.col("previous")).alias("previous"))


def diff(points: DataFrame) -> DataFrame:
    return with_previous(points).where("previous_key is not null").select("key", (F.col("value") - F.col("previous")).alias("value"))


def rate(points: DataFrame, unit: int) -> DataFrame:
    moved = (F.col("value") - F.col("previous")).cast("double") * F.lit(float(unit))
    return with_previous(points).where("previous_key is not null").select("key", (moved / (F.col("key") - F.col("previous_key"))).alias("value"))


def sampler(points: DataFrame, unit: int) -> DataFrame:
    scaled = F.col("value").cast("double") * F.lit(float(unit))
    return with_previous(points).where("previous_key is not null").select("key", (scaled / (F.col("key") - F.col("previous_key"))).alias("value"))


def div(points: DataFrame, divisor: float) -> DataFrame:
    return points.select("key", F.try_divide(F.col("value").cast("double"), F.lit(float(divisor))).alias("value"))


def threshold(points: DataFrame, op: str, value: float) -> DataFrame:
    v = F.col("value")
    tests = {"gt": v > value, "gte": v >= value, "eq": v == value, "ne": v != value, "lte": v <= value, "lt": v < value}
    if op not in tests:
        raise StatementError(f"unknown comparison {op}")
    return points.where(tests[op])


def bucketed(points: DataFrame, func: str, start: int, end: int, width: int) -> DataFrame:
    """max, min, sum, count, avg, first, last or dev (the population variance) over buckets of width keys."""
    v = F.col("value")
    aggs = {"max": lambda: F.max(v), "min": lambda: F.min(v), "sum": lambda: F.sum(v), "count": lambda: F.count(v), "avg": lambda: F.avg(v), "first": lambda: F.min_by(v, "key"), "last": lambda: F.max_by(v, "key"), "dev": lambda: F.var_pop(v)}
    if func not in aggs:
        raise StatementError(f"unknown aggregator {func}")
    return tumbling(points, start, end, width).groupBy(BUCKET).agg(aggs[func]().alias("value")).withColumnRenamed(BUCKET, "key")


def percentile(points: DataFrame, p: float, start: int, end: int, width: int) -> DataFrame:
    """Per bucket the value of rank floor(p * (n - 1)), without interpolation.

    Values are counted first and the counts cut into ranges; the sums of ranges tell in which one the rank lies, and only that is scanned.
    """
    ensure_checkpoint_dir(points.sparkSession)
    counted = tumbling(points, start, end, width).groupBy(BUCKET, "value").agg(F.count(F.lit(1)).alias("n"))
    cut = counted.repartitionByRange(_parts(points), BUCKET, "value").withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = cut.groupBy(BUCKET, "_range").agg(F.sum("n").alias("_n"))
    by = Window.partitionBy(BUCKET)
    placed = sums.withColumns({"_upto": F.sum("_n").over(by.orderBy("_range")), "_total": F.sum("_n").over(by)}).withColumn("_rank", F.floor(F.lit(float(p)) * (F.col("_total") - 1)))
    hit = placed.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))).select(BUCKET, "_range", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    ranked = cut.join(hit, [BUCKET, "_range"]).withColumn("upto", F.sum("n").over(Window.partitionBy(BUCKET).orderBy("value")))
    return ranked.where((F.col("upto") > F.col("_rank")) & (F.col("upto") - F.col("n") <= F.col("_rank"))).select(F.col(BUCKET).alias("key"), "value")


def ingest_datapoints(session, posted: Mapping[str, Any] | Sequence[Mapping[str, Any]]) -> None:
    """Metrics as {name, tags, datapoints: [[ms, value], ...]} (or timestamp and value) into the catalog; with annotation: {category, title, description} its notes."""
    for m in [posted] if isinstance(posted, Mapping) else posted:
        if "annotation" in m:
            note = m["annotation"]
            session.annotations.add(m["name"], m.get("tags") or {}, note.get("category") or [], note.get("title", ""), note.get("description", ""))
            if "datapoints" not in m and "timestamp" not in m:
                continue
        points = m.get("datapoints") or [[m["timestamp"], m["value"]]]
        session.insert_row_records([m["name"]], [int(k) for k, _ in points], [[v] for _, v in points], [m.get("tags") or {}], precision="ms")


def _ms(when: Mapping[str, Any], now_ms: int) -> int:
    return now_ms - int(when["value"]) * REST_UNIT_MS[when["unit"]]


def query_datapoints(session, query: Mapping[str, Any], now_ms: int) -> list[DataFrame]:
    """One DataFrame (key in ns, value) per metric and aggregator of the query."""
    start = query.get("start_absolute") if "start_absolute" in query else _ms(query["start_relative"], now_ms)
    end = query.get("end_absolute") if "end_absolute" in query else _ms(query["end_relative"], now_ms) if "end_relative" in query else now_ms
    low, high = int(start) * 1_000_000, int(end) * 1_000_000
    out = []
    for metric in query["metrics"]:
        tags = metric.get("tags")
        rule = ("with", ("and", [("or", [("tag", k, v) for v in vs]) for k, vs in tags.items()])) if tags else None
        names = session.catalog.series([metric["name"]], rule)
        points = first_present(session.catalog.scan(names), names) if names else session.spark.createDataFrame([], "key bigint, value double")
        points = points.where((F.col("key") >= low) & (F.col("key") <= high))
        for agg in metric.get("aggregators") or [{"name": "none"}]:
            kind = agg["name"]
            span = agg.get("sampling")
            step = int(span["value"]) * REST_UNIT_MS[span["unit"]] * 1_000_000 if span else high - low + 1
            unit = REST_UNIT_MS.get(agg.get("unit", "millis"), 1) * PRECISION_NS["ms"]
            if kind == "none":
                out.append(points)
            elif kind == "diff":
                out.append(diff(points))
            elif kind == "rate":
                out.append(rate(points, unit))
            elif kind == "sampler":
                out.append(sampler(points, unit))
            elif kind == "div":
                out.append(div(points, float(agg["divisor"])))
            elif kind == "filter":
                out.append(threshold(points, agg["filter_op"], float(agg["threshold"])))
            elif kind == "percentile":
                out.append(percentile(points, float(agg["percentile"]), low, high + 1, step))
            elif kind == "save_as":
                saved = full_name(agg["metric_name"], {**split_name(names[0])[1], "saved_from": metric["name"]}) if names else agg["metric_name"]
                session.catalog.add(points.withColumnRenamed("value", saved), clean=False)
                out.append(points)
            else:
                out.append(bucketed(points, kind, low, high + 1, step))
    return out


def query_annotations(session, query: Mapping[str, Any]) -> list[dict[str, Any]]:
    """The annotations that a query's metrics ask for by name, tags and category, each once, in order of adding."""
    found: list[dict[str, Any]] = []
    for m in query["metrics"]:
        wanted = m.get("tags") or {}
        for a in session.annotations.find(m.get("name"), (m.get("annotation") or {}).get("category") or ()):
            if a not in found and all(a["tags"].get(k) in vs for k, vs in wanted.items()):
                found.append(a)
    return found


class Annotations:
    """Category tags, title and description attached to metrics, kept beside the data."""

    def __init__(self):
        self.held: list[dict[str, Any]] = []

    def add(self, metric: str, tags: Mapping[str, str], categories: Sequence[str], title: str = "", description: str = "") -> None:
        self.held.append({"metric": metric, "tags": dict(tags), "categories": set(categories), "title": title, "description": description})

    def find(self, metric: str | None = None, categories: Sequence[str] = ()) -> list[dict[str, Any]]:
        return [a for a in self.held if (metric is None or a["metric"] == metric) and set(categories) <= a["categories"]]

    def update(self, metric: str, categories: Sequence[str], new: Sequence[str], title: str | None = None, description: str | None = None) -> None:
        for a in self.find(metric, categories):
            a["categories"] = set(new)
            a["title"] = a["title"] if title is None else title
            a["description"] = a["description"] if description is None else description

    def delete(self, metric: str, categories: Sequence[str] = ()) -> None:
        gone = self.find(metric, categories)
        self.held = [a for a in self.held if a not in gone]
