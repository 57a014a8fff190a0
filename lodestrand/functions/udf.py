"""User functions in Python: row to row (UDTF), set to row (UDAF), set to set (UDSF) and transformers of jobs.

A registered class has transform(rows), where rows are lists of values as in a table; classes are sent to the executors
by value.  Row-to-row functions run over Arrow batches.  The sample functions are native columns.  A class that has an
attribute returns (a Spark type such as "bigint") declares its output type; without one it is found on one row when a query is planned.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators.common import col
from lodestrand.plans.errors import StatementError

from .transformers import NATIVE


@dataclass
class Registered:
    kind: str
    name: str
    make: Callable[[], Any]
    file: str = ""
    cls: str = ""
    returns: str | None = None
    #: A function of a column (of a DataFrame for a transformer) that takes the place of the class.
    native: Callable[[Any], Any] | None = None


def _sample(kind: str, name: str, native: Callable[[Any], Any]) -> Registered:
    return Registered(kind, name, lambda: None, cls=name, native=native)


#: On no values udf_sum and udf_count are 0, the others null.
SAMPLES = [
    _sample("udtf", "cos", F.cos),
    _sample("udaf", "udf_min", F.min),
    _sample("udaf", "udf_max", F.max),
    _sample("udaf", "udf_sum", lambda c: F.coalesce(F.sum(c), F.lit(0))),
    _sample("udaf", "udf_avg", F.avg),
    _sample("udaf", "udf_count", F.count),
    *(_sample("transform", name, f) for name, f in NATIVE.items()),
]


class Registry:
    def __init__(self):
        self.by_name = {r.name: r for r in SAMPLES}

    def register(self, kind: str, cls: str, file: str, name: str) -> None:
        spec = importlib.util.spec_from_file_location("lodestrand_user_" + name, file)
        if spec is None or spec.loader is None:
            raise StatementError(f"cannot read {file}")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(__import__("sys").modules.setdefault(spec.name, module))
        made = getattr(module, cls)
        self.by_name[name] = Registered(kind, name, made, file, cls, getattr(made, "returns", None))

    def drop(self, name: str) -> None:
        if self.by_name.pop(name, None) is None:
            raise StatementError(f"no task {name}")

    def get(self, name: str) -> Registered:
        try:
            return self.by_name[name]
        except KeyError:
            raise StatementError(f"unknown function {name}") from None

    def rows(self) -> list[tuple[str, str, str, str]]:
        return [(r.name, r.cls or r.make.__name__, r.file, r.kind.upper()) for r in self.by_name.values()]


def _value_type(value) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    return T.DoubleType() if isinstance(value, float) else T.StringType()


def _rows(pdf: pd.DataFrame) -> list[list]:
    return pdf.astype(object).where(pdf.notna(), None).to_numpy().tolist()


def _probe(r: Registered, df: DataFrame, names: list[str], many: bool) -> T.DataType:
    """The declared type, else that of the result on one row without nulls."""
    if r.returns:
        return T._parse_datatype_string(r.returns)
    first = plain(df, names).dropna().limit(1).collect()
    if not first:
        return T.DoubleType()
    out = r.make().transform([list(first[0])] if many else list(first[0]))
    out = out[0] if many and out and isinstance(out[0], list) else out
    return _value_type(out[0])


def plain(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns under plain names c0, c1, ...: names with dots cannot be handed to Python functions."""
    return df.select(*[col(n).alias(f"c{i}") for i, n in enumerate(names)])


def row_to_row(df: DataFrame, kept: list[str], entries: list[tuple[str, str, Registered | None]]) -> DataFrame:
    """The kept columns and one output per (output, column, function), None for the column as it is.

    Each value is transformed on its own, all outputs in one pass over Arrow batches; native functions need none.  No shuffle.
    """
    kept = list(kept)
    values = [col(n) if f is None else f.native(col(n)) if f.native else col(n) for _, n, f in entries]
    inner = df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(kept)], *[c.alias(f"c{i}") for i, c in enumerate(values)])
    names = [*kept, *[o for o, _, _ in entries]]
    python = {f"c{i}": f for i, (_, _, f) in enumerate(entries) if f is not None and not f.native}
    if not python:
        return inner.toDF(*names)
    kinds = {c: _probe(f, df, [n], False) for (c, f), n in zip(python.items(), [n for _, n, f in entries if f is not None and not f.native], strict=True)}
    shape = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in inner.schema])
    make = {c: f.make for c, f in python.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {c: m() for c, m in make.items()}
        for pdf in batches:
            for c, f in own.items():
                pdf[c] = pd.Series([f.transform([x])[0] for x in pdf[c].astype(object).where(pdf[c].notna(), None)], index=pdf.index, dtype=object)
            yield pdf

    return inner.mapInPandas(run, shape).toDF(*names)


def set_to_row(df: DataFrame, r: Registered, names: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """UDAF: one row per group of by (or one in all).  The function needs its whole set, so a group is one task's work."""
    shape = T.StructType(([T.StructField(by, T.LongType())] if by else []) + [T.StructField(o, _probe(r, df, [n], True)) for n, o in zip(names, outputs, strict=True)])
    make = r.make

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf.columns = [*([by] if by else []), *names]
        f, out = make(), {by: [pdf[by].iloc[0]]} if by else {}
        for n, o in zip(names, outputs, strict=True):
            got = f.transform([[x] for x in pdf[n].astype(object).where(pdf[n].notna(), None)])
            got = got[0] if got and isinstance(got[0], list) else got
            out[o] = [got[0]]
        return pd.DataFrame(out)

    return plain(df, [*([by] if by else []), *names]).groupBy(*(["c0"] if by else [])).applyInPandas(run, shape)


def set_to_set(df: DataFrame, r: Registered, names: list[str], outputs: list[str]) -> DataFrame:
    """UDSF: the rows in key order in, any rows out, without a key; the set is one task's work by its contract."""
    shape = T.StructType([T.StructField(o, _probe(r, df, [n], True)) for n, o in zip(names, outputs, strict=True)])
    make, held = r.make, [c for c in df.columns if c == "key" or c in names]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf.columns = held
        got = make().transform(_rows(pdf.sort_values("key")[names] if "key" in pdf else pdf[names]))
        return pd.DataFrame(got, columns=outputs)

    return plain(df, held).groupBy().applyInPandas(run, shape)
