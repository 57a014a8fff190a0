"""Series of the engine: typed columns named by dotted paths and tags, resolved before any plan exists.

A source is a DataFrame keyed by the bigint column key, with one column per series.  Inserts add sources, deletes wrap
them in projections; a scan merges the sources that hold the wanted series with one aggregation by key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators.common import col, ensure_checkpoint_dir

from .errors import StatementError

# The six types and their Spark forms.
TYPES = {"BOOLEAN": "boolean", "INTEGER": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "BINARY": "string"}
_OF_SPARK = {T.BooleanType: "BOOLEAN", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "BINARY"}


def full_name(path: str, tags: Mapping[str, str] | None = None) -> str:
    return path + ("{" + ",".join(f"{k}={v}" for k, v in sorted(tags.items())) + "}" if tags else "")


def split_name(name: str) -> tuple[str, dict[str, str]]:
    m = re.fullmatch(r"(.*?)\{(.*)\}", name)
    return (m[1], dict(t.split("=", 1) for t in m[2].split(","))) if m else (name, {})


def matches(pattern: str, path: str) -> bool:
    """Whether a path without tags fits a pattern, in which * stands for any text, dots included."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), path) is not None


def tags_match(rule, tags: Mapping[str, str]) -> bool:
    if rule is None:
        return True
    if rule[0] == "without":
        return not tags
    if rule[0] == "precise":
        return dict(tags) in rule[1]
    if rule[0] == "with":
        return bool(tags) and tags_match(rule[1], tags)
    if rule[0] == "tag":
        return rule[1] in tags and (rule[2] == "*" or tags[rule[1]] == rule[2])
    return (all if rule[0] == "and" else any)(tags_match(r, tags) for r in rule[1])


def series_type(dtype: T.DataType) -> str:
    try:
        return _OF_SPARK[type(dtype)]
    except KeyError:
        raise StatementError(f"a series cannot hold {dtype.simpleString()}") from None


@dataclass
class Source:
    df: DataFrame
    #: True if no key occurs twice and no row is empty, so that a scan of this source alone needs no merging.
    clean: bool = True
    names: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.names = self.names or {c for c in self.df.columns if c != "key"}


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark, self.sources, self.types = spark, [], {}
        #: Where inserts and deletes are kept beside this catalog (sources.store), if anywhere.
        self.store = None

    def attach(self, store) -> None:
        """Take in the series of a store; from now on inserts and deletes go there as well."""
        store.load(self)
        self.store = store

    def insert(self, df: DataFrame, clean: bool = True) -> None:
        """Add a source; with a store it is written there first, and read from there."""
        if self.store is not None:
            self.store.write(df)
            number, kind = self.store.entries()[-1]
            df = self.spark.read.parquet(f"{self.store.folder}/{kind}-{number:08d}")
        self.add(df, clean)

    def register(self, df: DataFrame, prefix: str = "", key: str = "key", clean: bool = True) -> None:
        """Add the columns of df as series prefix.column; clean=False if keys may repeat (later rows of a scan are not ordered: any non-null value holds)."""
        keep = [c for c in df.columns if c != key and type(df.schema[c].dataType) in _OF_SPARK]
        dotted = prefix + "." if prefix else ""
        self.add(df.select(col(key).cast("long").alias("key"), *[col(c).alias(dotted + c) for c in keep]), clean)

    def add(self, df: DataFrame, clean: bool = True) -> None:
        for f in df.schema:
            if f.name != "key":
                kind = series_type(f.dataType)
                if self.types.setdefault(f.name, kind) != kind:
                    raise StatementError(f"series {f.name} holds {self.types[f.name]}, not {kind}")
        self.sources.append(Source(df, clean))

    def series(self, patterns: Iterable[str] | None = None, tags=None) -> list[str]:
        """Full names, sorted, of the series that fit one of the patterns and the tag rule."""
        wanted = None if patterns is None else list(patterns)
        out = []
        for name in sorted(self.types):
            path, own = split_name(name)
            if (wanted is None or any(p == name or matches(p, path) for p in wanted)) and tags_match(tags, own):
                out.append(name)
        return out

    def scan(self, names: Sequence[str]) -> DataFrame:
        """key and the named series; equal keys are merged (the later source's non-null value holds), empty rows dropped."""
        if not names:
            return self.spark.createDataFrame([], "key bigint")
        parts = [(i, s, [n for n in names if n in s.names]) for i, s in enumerate(self.sources) if any(n in s.names for n in names)]
        if len(parts) == 1 and parts[0][1].clean:
            return parts[0][1].df.select("key", *[col(n) for n in names]).dropna(how="all", subset=[f"`{n}`" for n in names])
        whole = None
        for i, s, held in parts:
            df = s.df.select("key", F.lit(i).alias("_at"), *[col(n) for n in held])
            whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
        merged = whole.groupBy("key").agg(*[F.max_by(col(n), F.when(col(n).isNotNull(), F.col("_at"))).alias(n) for n in names])
        return merged.dropna(how="all", subset=[f"`{n}`" for n in names])

    def parts(self, names: Sequence[str]) -> list[DataFrame]:
        """The sources of a scan one by one, if none needs merging and no series is in two of them; else none."""
        held = [(s, [n for n in names if n in s.names]) for s in self.sources]
        held = [(s, own) for s, own in held if own]
        if not all(s.clean for s, _ in held) or sum(len(own) for _, own in held) != len(set(names)):
            return []
        return [s.df.select("key", *[col(n) for n in own]) for s, own in held]

    def delete(self, names: Sequence[str], ranges: Sequence[tuple[int, int]] | None) -> None:
        """Null the values of the series at keys within the closed ranges; None drops the series."""
        if self.store is not None and names:
            self.store.delete(names, ranges)
        if ranges is None:
            for s in self.sources:
                gone = s.names & set(names)
                if gone:
                    s.df, s.names = s.df.drop(*gone), s.names - gone
            self.sources = [s for s in self.sources if s.names]
            for n in names:
                self.types.pop(n, None)
            return
        hit = F.lit(False)
        for low, high in ranges:
            hit = hit | F.col("key").between(low, high)
        for s in self.sources:
            held = s.names & set(names)
            if held:
                s.df = s.df.select("key", *[(F.when(~hit, col(c)) if c in held else col(c)).alias(c) for c in s.df.columns if c != "key"])

    def compact(self) -> None:
        """Bring all sources together into one, written to the checkpoint folder: every insert adds a source, and a scan merges those of its series."""
        if len(self.sources) > 1:
            ensure_checkpoint_dir(self.spark)
            self.sources = [Source(self.scan(self.series()).checkpoint())]

    def clear(self) -> None:
        if self.store is not None:
            self.store.clear()
        self.sources, self.types = [], {}
