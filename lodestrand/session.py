"""The engine's front door: statements as text and the structured calls of a client session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import udf as U
from .functions.timeutil import to_ns
from .operators.common import col, numbered
from .operators.rest import Annotations
from .plans.catalog import TYPES, Catalog, full_name
from .plans.errors import StatementError
from .plans.parser import Item, Select, Statement, Window, parse, split_statements
from .plans.planner import Planner, key_ranges
from .transform import Jobs


def _literal_type(values: Sequence[Any]) -> str:
    first = next((v for v in values if v is not None), None)
    if isinstance(first, bool):
        return "BOOLEAN"
    if isinstance(first, int):
        return "LONG"
    return "DOUBLE" if isinstance(first, float) else "BINARY"


class Session:
    """A catalog of series and the statements on it.  Results are lazy DataFrames, keyed ones in order of key unless by_key is False."""

    def __init__(self, spark: SparkSession, by_key: bool = True):
        self.spark, self.by_key = spark, by_key
        self.catalog = Catalog(spark)
        self.functions = U.Registry()
        self.planner = Planner(self.catalog, self.functions)
        self.jobs = Jobs(self)
        self.annotations = Annotations()

    def register(self, df: DataFrame, prefix: str = "", key: str = "key", clean: bool = True) -> Session:
        self.catalog.register(df, prefix, key, clean)
        return self

    def attach(self, folder: str) -> Session:
        """Keep the series in a folder that the cluster shares: those in it are read, later inserts and deletes are written to it."""
        from .sources.store import ParquetStore

        self.catalog.attach(ParquetStore(self.spark, folder))
        return self

    # --- text
    def execute(self, text: str, by_key: bool | None = None) -> DataFrame | None:
        """Run a statement, or several that are parted by semicolons, all of which are read before the first is run; the result is that of the last one."""
        out = None
        for s in [parse(part) for part in split_statements(text)]:
            out = self.planner.query(s, self.by_key if by_key is None else by_key) if isinstance(s, Select) else self._run(s)
        return out

    sql = execute_sql = execute

    def _run(self, s: Statement) -> DataFrame | None:
        a, frame = s.args, self.spark.createDataFrame
        if s.kind == "insert":
            return self._insert(a["columns"], a["rows"])
        if s.kind == "insert_select":
            return self._insert_select(a["columns"], a["query"], a["shift"])
        if s.kind == "delete":
            return self.catalog.delete(self.catalog.series(a["paths"], a["tags"]), key_ranges(a["where"]))
        if s.kind == "delete_series":
            return self.catalog.delete(self.catalog.series(a["paths"], a["tags"]), None)
        if s.kind == "clear":
            return self.catalog.clear()
        if s.kind == "show_series":
            return self.show_time_series(a["paths"] or None, a["tags"], a["limit"], a["offset"])
        if s.kind == "count_points":
            return self.count_points()
        if s.kind == "show_replicas":
            return frame([(1,)], "replicas int")
        if s.kind == "show_cluster":
            return frame([("spark", self.spark.version, self.spark.sparkContext.master)], "kind string, version string, master string")
        if s.kind == "add_storage":
            from .sources import open_source

            for ip, port, kind, extra in a["engines"]:
                options = dict(x.split("=", 1) for x in extra.split(",") if "=" in x)
                prefix = options.pop("prefix", "")
                self.register(open_source(self.spark, kind, host=ip, port=port, **options), prefix, options.get("key", "key"), clean=False)
            return None
        if s.kind == "register":
            return self.functions.register(a["kind"], a["cls"], a["file"], a["name"])
        if s.kind == "drop_function":
            return self.functions.drop(a["name"])
        if s.kind == "show_functions":
            return frame(self.functions.rows(), "name string, class string, file string, kind string")
        if s.kind == "commit_job":
            return frame([(self.jobs.commit_file(a["file"]),)], "job bigint")
        if s.kind == "job_status":
            return frame([(a["job"], self.jobs.status(a["job"]))], "job bigint, state string")
        if s.kind == "cancel_job":
            return self.jobs.cancel(a["job"])
        if s.kind == "jobs_in":
            return frame([(j,) for j in self.jobs.in_state(a["state"])], "job bigint")
        raise StatementError(f"unknown statement {s.kind}")

    def _insert(self, columns: Sequence[tuple[str, Mapping[str, str]]], rows: Sequence[Sequence[Any]]) -> None:
        names = [full_name(p, t) for p, t in columns]
        if any("*" in n for n in names):
            raise StatementError("an insert names its series in full")
        kinds = [self.catalog.types.get(n) or _literal_type([r[i + 1] for r in rows]) for i, n in enumerate(names)]
        cast = {"DOUBLE": float, "FLOAT": float}
        data = [(r[0], *[None if v is None or v != v else cast.get(k, lambda x: x)(v) for v, k in zip(r[1:], kinds, strict=True)]) for r in rows]
        # the last row of a key holds, its nulls aside
        merged: dict[int, list] = {}
        for key, *values in data:
            held = merged.setdefault(key, [None] * len(names))
            held[:] = [h if v is None else v for h, v in zip(held, values, strict=True)]
        shape = T.StructType([T.StructField("key", T.LongType())] + [T.StructField(n, T._parse_datatype_string(TYPES[k])) for n, k in zip(names, kinds, strict=True)])
        self.catalog.insert(self.spark.createDataFrame([(k, *v) for k, v in merged.items()], shape))

    def _insert_select(self, columns, query: Select, shift: int) -> None:
        df = self.planner.plan(query).df
        values = [c for c in df.columns if c != "key"]
        if len(values) != len(columns):
            raise StatementError("the query of an insert has another number of columns")
        if "key" not in df.columns:
            df = numbered(df, "key")  # rows without a key are numbered in their order
        from .plans.catalog import split_name

        names = [full_name(p, {**t, **split_name(v)[1]}) for (p, t), v in zip(columns, values, strict=True)]
        self.catalog.insert(df.select((F.col("key") + shift).alias("key"), *[col(v).alias(n) for v, n in zip(values, names, strict=True)]))

    # --- structured calls
    def query(self, paths: Sequence[str], start: int, end: int, tags=None, precision: str = "ns") -> DataFrame:
        return self._structured([Item("path", path=p) for p in paths], start, end, tags, precision)

    def _structured(self, items, start, end, tags, precision="ns", **more) -> DataFrame:
        start, end = to_ns(start, precision), to_ns(end, precision)
        rule = tags if tags is None or isinstance(tags, tuple) else ("with", ("and", [("or", [("tag", k, v) for v in vs]) for k, vs in tags.items()]))
        names = self.catalog.series([i.path for i in items], rule)
        where = ("and", [("key", ">=", start), ("key", "<", end)])
        q = Select(items, where=where, tags=rule, **more)
        planner = Planner(self.catalog, self.functions)
        base = self.catalog.scan(names)
        planner.source = lambda _q, _w: (__import__("lodestrand.plans.planner", fromlist=["Relation"]).Relation(base), lambda p: p)
        return planner.query(q, self.by_key)

    def aggregate_query(self, paths: Sequence[str], start: int, end: int, func: str, tags=None, precision: str = "ns") -> DataFrame:
        return self._structured([Item("call", path=p, func=func) for p in paths], start, end, tags, precision)

    def downsample_query(self, paths: Sequence[str], start: int, end: int, func: str, width: int, slide: int | None = None, tags=None, precision: str = "ns") -> DataFrame:
        w = Window(to_ns(start, precision), to_ns(end, precision), to_ns(width, precision), None if slide is None else to_ns(slide, precision))
        return self._structured([Item("call", path=p, func=func) for p in paths], start, end, tags, precision, window=w)

    def last_query(self, paths: Sequence[str], start: int, tags=None, precision: str = "ns") -> DataFrame:
        """(key, path, value) of the last point of each series at or after start."""
        return self._structured([Item("call", path=p, func="last") for p in paths], to_ns(start, precision), 2**63 - 1, tags)

    def insert_column_records(self, paths: Sequence[str], keys: Sequence[int], values: Sequence[Sequence[Any]], tags: Sequence[Mapping[str, str] | None] | None = None, precision: str = "ns") -> None:
        """values[i] are those of paths[i]; None is no value (the aligned and the non-aligned layout alike)."""
        self.insert_row_records(paths, keys, [list(r) for r in zip(*values, strict=True)], tags, precision)

    def insert_row_records(self, paths: Sequence[str], keys: Sequence[int], rows: Sequence[Sequence[Any]], tags: Sequence[Mapping[str, str] | None] | None = None, precision: str = "ns") -> None:
        self._insert([(p, (tags[i] if tags else None) or {}) for i, p in enumerate(paths)], [[to_ns(k, precision), *r] for k, r in zip(keys, rows, strict=True)])

    insert_non_aligned_column_records, insert_non_aligned_row_records = insert_column_records, insert_row_records

    def delete_data(self, paths: Sequence[str], start: int, end: int, tags=None, precision: str = "ns") -> None:
        self.catalog.delete(self.catalog.series(paths, tags), [(to_ns(start, precision), to_ns(end, precision) - 1)])

    def delete_time_series(self, paths: Sequence[str], tags=None) -> None:
        self.catalog.delete(self.catalog.series(paths, tags), None)

    def show_time_series(self, paths: Sequence[str] | None = None, tags=None, limit: int | None = None, offset: int = 0) -> DataFrame:
        names = self.catalog.series(paths, tags)[offset : None if limit is None else offset + limit]
        return self.spark.createDataFrame([(n, self.catalog.types[n]) for n in names], "path string, type string")

    def count_points(self) -> DataFrame:
        names = self.catalog.series()
        whole = self.catalog.scan(names)
        total = sum((F.count(col(n)) for n in names[1:]), F.count(col(names[0]))) if names else F.lit(0).cast("long")
        return whole.agg(total.alias("points"))

    def write(self, df: DataFrame, path: str, kind: str = "parquet") -> None:
        from .sources import write_result

        write_result(df, path, kind)
