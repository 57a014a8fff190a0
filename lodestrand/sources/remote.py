"""Time-series stores that speak HTTP: read by key ranges in parallel, written in batches from the executors.

A wire protocol is a pair of functions: requests for a key range to points (path, key, value), and points to a request.  Keys are ns.
"""

from __future__ import annotations

import base64
import csv
import io
import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.plans.catalog import full_name, split_name

Point = tuple[str, int, float]
#: Points sent in one request.
BATCH = 5_000


def _post(url: str, body: bytes, headers: dict[str, str]) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=60) as answer:
        return answer.read()


@dataclass
class Protocol:
    """read(base, names, low, high, options) gives points with low <= key < high; write(base, points, options) sends some."""

    read: Callable[[str, Sequence[str], int, int, dict[str, str]], Iterable[Point]]
    write: Callable[[str, Sequence[Point], dict[str, str]], None]


# --- OpenTSDB: metrics with tags, keys in ms
def _tsdb_read(base, names, low, high, options):
    for name in names:
        metric, tags = split_name(name)
        query = {"metric": metric, "aggregator": "none", "filters": [{"type": "literal_or", "tagk": k, "filter": v, "groupBy": True} for k, v in tags.items()]}
        asked = {"start": low // 1_000_000, "end": (high - 1) // 1_000_000, "msResolution": True, "queries": [query]}
        for found in json.loads(_post(f"{base}/api/query", json.dumps(asked).encode(), {"Content-Type": "application/json"})):
            for at, value in found["dps"].items():
                if low <= int(at) * 1_000_000 < high:
                    yield full_name(found["metric"], found.get("tags")), int(at) * 1_000_000, float(value)


def _tsdb_write(base, points, options):
    sent = [{"metric": split_name(p)[0], "timestamp": k // 1_000_000, "value": v, "tags": split_name(p)[1] or {"source": "none"}} for p, k, v in points]
    _post(f"{base}/api/put", json.dumps(sent).encode(), {"Content-Type": "application/json"})


# --- InfluxDB 2: measurement.field with tags, keys in ns
def _influx_headers(options, kind):
    return {"Authorization": f"Token {options.get('token', '')}", "Content-Type": kind, "Accept": "application/csv"}


def _influx_read(base, names, low, high, options):
    from datetime import datetime, timezone

    for name in names:
        path, tags = split_name(name)
        measurement, _, field = path.rpartition(".")
        text = lambda s: json.dumps(s, ensure_ascii=False)
        same = "".join(f" and r[{text(k)}] == {text(v)}" for k, v in tags.items())
        flux = f"from(bucket: {text(options['bucket'])}) |> range(start: time(v: {low}), stop: time(v: {high})) |> filter(fn: (r) => r._measurement == {text(measurement)} and r._field == {text(field)}{same})"
        answer = _post(f"{base}/api/v2/query?org={options['org']}", flux.encode(), _influx_headers(options, "application/vnd.flux")).decode()
        header: list[str] = []
        for row in csv.reader(line for line in io.StringIO(answer) if line.strip() and not line.startswith("#")):
            if "_time" in row:
                header = row
                continue
            r = dict(zip(header, row, strict=False))
            whole, _, rest = r["_time"].rstrip("Z").partition(".")
            at = int(datetime.fromisoformat(whole).replace(tzinfo=timezone.utc).timestamp()) * 10**9 + int(rest.ljust(9, "0")[:9] or 0)
            yield name, at, float(r["_value"])


def _influx_write(base, points, options):
    mask = lambda s: s.replace("\\", "\\\\").replace(",", "\\,").replace(" ", "\\ ").replace("=", "\\=")
    lines = []
    for p, k, v in points:
        path, tags = split_name(p)
        measurement, _, field = path.rpartition(".")
        lines.append(f"{mask(measurement)}{''.join(f',{mask(a)}={mask(b)}' for a, b in sorted(tags.items()))} {mask(field)}={v!r} {k}")
    _post(f"{base}/api/v2/write?org={options['org']}&bucket={options['bucket']}&precision=ns", "\n".join(lines).encode(), _influx_headers(options, "text/plain"))


# --- IoTDB's REST service: paths below root, keys in ms
def _iot_headers(options):
    pair = f"{options.get('user', 'root')}:{options.get('password', 'root')}".encode()
    return {"Authorization": "Basic " + base64.b64encode(pair).decode(), "Content-Type": "application/json"}


def _iot_read(base, names, low, high, options):
    for name in names:
        device, _, leaf = name.rpartition(".")
        sql = f"SELECT {leaf} FROM root.{device} WHERE time >= {-(-low // 1_000_000)} AND time < {-(-high // 1_000_000)}"
        answer = json.loads(_post(f"{base}/rest/v2/query", json.dumps({"sql": sql}).encode(), _iot_headers(options)))
        for column in answer.get("values") or []:
            for at, value in zip(answer["timestamps"], column, strict=True):
                if value is not None:
                    yield name, int(at) * 1_000_000, float(value)


def _iot_write(base, points, options):
    by_device: dict[str, list[tuple[str, int, float]]] = {}
    for p, k, v in points:
        by_device.setdefault(p.rpartition(".")[0], []).append((p.rpartition(".")[2], k // 1_000_000, v))
    for device, held in by_device.items():
        leaves, times = sorted({leaf for leaf, _, _ in held}), sorted({k for _, k, _ in held})
        at = {(leaf, k): v for leaf, k, v in held}
        sent = {"device": f"root.{device}", "is_aligned": False, "timestamps": times, "measurements": leaves, "data_types": ["DOUBLE"] * len(leaves), "values": [[at.get((leaf, k)) for k in times] for leaf in leaves]}
        _post(f"{base}/rest/v2/insertTablet", json.dumps(sent).encode(), _iot_headers(options))


PROTOCOLS = {"opentsdb": Protocol(_tsdb_read, _tsdb_write), "influxdb": Protocol(_influx_read, _influx_write), "iotdb": Protocol(_iot_read, _iot_write)}


def read_points(spark: SparkSession, kind: str, base: str, names: Sequence[str], start: int, end: int, parts: int = 8, **options: str) -> DataFrame:
    """(path, key, value) of the named series with start <= key < end, one task for each part of the range."""
    protocol = PROTOCOLS[kind]
    step = max(1, -(-(end - start) // parts))
    ranges = [(low, min(low + step, end)) for low in range(start, end, step)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low, high in zip(pdf["low"].tolist(), pdf["high"].tolist(), strict=True):
                yield pd.DataFrame(list(protocol.read(base, names, low, high, options)), columns=["path", "key", "value"]).astype({"key": "int64", "value": "float64"})

    return spark.createDataFrame(ranges, "low bigint, high bigint").repartition(len(ranges), "low").mapInPandas(run, "path string, key bigint, value double")


def wide(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Points as a keyed table with one column per named series."""
    return points.groupBy("key").pivot("path", list(names)).agg(F.max("value"))


def read_remote(spark: SparkSession, host: str, port: int, kind: str, series: str = "", start: Any = 0, end: Any = 2**62, parts: Any = 8, **options: str) -> DataFrame:
    """A keyed table; series: paths parted by semicolons."""
    names = [n for n in series.split(";") if n]
    return wide(read_points(spark, kind, f"http://{host}:{port}", names, int(start), int(end), int(parts), **options), names)


def write_points(points: DataFrame, kind: str, base: str, **options: str) -> int:
    """Send (path, key, value) from the executors in batches; the number of points sent.  A batch that is sent again replaces itself."""
    protocol = PROTOCOLS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(zip(pdf["path"].tolist(), pdf["key"].tolist(), pdf["value"].tolist(), strict=True))
            for k in range(0, len(rows), BATCH):
                protocol.write(base, rows[k : k + BATCH], options)
            yield pd.DataFrame({"n": [len(rows)]})

    kept = points.where("path is not null and key is not null and value is not null").select("path", "key", "value")
    return kept.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
