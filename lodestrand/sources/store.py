"""Stores: where series live outside a session.  A store reads, writes, deletes, lists its series and tells its key range."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.common import col

from ..plans.catalog import Catalog, series_type

Ranges = Sequence[tuple[int, int]] | None


class Store(Protocol):
    def read(self, names: Sequence[str]) -> DataFrame: ...

    def write(self, df: DataFrame) -> None: ...

    def delete(self, names: Sequence[str], ranges: Ranges) -> None: ...

    def series(self) -> dict[str, str]: ...

    def boundary(self) -> tuple[int, int] | None: ...


class ParquetStore:
    """A folder of Parquet segments and deletes in order of writing.

    A write adds the segment NNN (keyed rows, one column per series), a delete the entry NNN of the log; both are numbered, so a session that
    opens the folder sees them in order, later values of a key over earlier ones.  compact() makes one segment of all.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- the folder, wherever Hadoop's file systems can reach
    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def entries(self) -> list[tuple[int, str]]:
        """(number, seg or del) of what was finished, in order."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        found = []
        for status in fs.listStatus(self._path("")):
            kind, _, number = status.getPath().getName().partition("-")
            if kind in ("seg", "del") and fs.exists(self._path(f"{kind}-{number}/_SUCCESS")):
                found.append((int(number), kind))
        return sorted(found)

    def _next(self, kind: str) -> str:
        held = self.entries()
        return f"{self.folder}/{kind}-{(held[-1][0] if held else 0) + 1:08d}"

    # --- the interface
    def write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._next("seg"))

    def delete(self, names: Sequence[str], ranges: Ranges) -> None:
        entry = json.dumps({"names": sorted(names), "ranges": None if ranges is None else [list(r) for r in ranges]})
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("overwrite").text(self._next("del"))

    def clear(self) -> None:
        self._fs().delete(self._path(""), True)

    def load(self, catalog: Catalog) -> None:
        """Add the series of the folder to a catalog."""
        for number, kind in self.entries():
            path = f"{self.folder}/{kind}-{number:08d}"
            if kind == "seg":
                catalog.add(self.spark.read.parquet(path))
            else:
                entry = json.loads(self.spark.read.text(path).first()[0])
                catalog.delete(entry["names"], None if entry["ranges"] is None else [tuple(r) for r in entry["ranges"]])

    def _catalog(self) -> Catalog:
        out = Catalog(self.spark)
        self.load(out)
        return out

    def read(self, names: Sequence[str]) -> DataFrame:
        return self._catalog().scan(list(names))

    def series(self) -> dict[str, str]:
        return dict(self._catalog().types)

    def boundary(self) -> tuple[int, int] | None:
        """The least and the greatest key, from the footers of the segments where the reader can; deletes are not looked at."""
        segments = [f"{self.folder}/seg-{n:08d}" for n, kind in self.entries() if kind == "seg"]
        if not segments:
            return None
        low, high = self.spark.read.option("mergeSchema", True).parquet(*segments).agg(F.min("key"), F.max("key")).first()
        return None if low is None else (low, high)

    def compact(self) -> None:
        """One segment of all that holds; plans over the folder have one source again."""
        held = self.entries()
        whole = self._catalog()
        if whole.types:
            self.write(whole.scan(whole.series()))
        fs = self._fs()
        for number, kind in reversed(held) if whole.types else held:  # the newest first: what is left stays older than the new segment
            fs.delete(self._path(f"{kind}-{number:08d}"), True)


class JdbcStore:
    """Tables of a relational store, one per first path node, with a key column and one column per series."""

    def __init__(self, spark: SparkSession, url: str, table: str, prefix: str = "", **options: str):
        self.spark, self.url, self.table, self.prefix, self.options = spark, url, table, prefix, options

    def _reader(self, table: str):
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options).load()

    def _short(self, name: str) -> str:
        return name[len(self.prefix) + 1 :] if self.prefix and name.startswith(self.prefix + ".") else name

    def _named(self, df: DataFrame) -> DataFrame:
        return df.select(*[col(c).alias(c if c == "key" or not self.prefix else f"{self.prefix}.{c}") for c in df.columns])

    def read(self, names: Sequence[str]) -> DataFrame:
        """Filters on the key and the choice of columns go to the store."""
        df = self._named(self._reader(self.table))
        return df.select("key", *[col(n) for n in names if n in df.columns])

    def write(self, df: DataFrame) -> None:
        df.select(*[col(c).alias(self._short(c)) for c in df.columns]).write.format("jdbc").options(url=self.url, dbtable=self.table, **self.options).mode("append").save()

    def statements(self, names: Sequence[str], ranges: Ranges) -> list[str]:
        """The SQL of a delete: values become null, without ranges columns go."""
        own = ['"' + self._short(n).replace('"', '""') + '"' for n in names]
        if ranges is None:
            return [f"ALTER TABLE {self.table} DROP COLUMN {c}" for c in own]
        where = " OR ".join(f'"key" BETWEEN {low} AND {high}' for low, high in ranges)
        return [f"UPDATE {self.table} SET {', '.join(f'{c} = NULL' for c in own)} WHERE {where}"]

    def delete(self, names: Sequence[str], ranges: Ranges) -> None:
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, self.options.get("user", ""), self.options.get("password", ""))
        try:
            for text in self.statements(names, ranges):
                connection.createStatement().executeUpdate(text)
        finally:
            connection.close()

    def series(self) -> dict[str, str]:
        return {f.name: series_type(f.dataType) for f in self._named(self._reader(self.table)).schema if f.name != "key"}

    def boundary(self) -> tuple[int, int] | None:
        low, high = self._reader(f'(SELECT min("key") a, max("key") b FROM {self.table}) t').first()
        return None if low is None else (low, high)
