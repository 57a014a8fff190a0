"""From a parsed query to a lazy DataFrame.  Names, wildcards, tags and levels are resolved here; nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import udf as U
from lodestrand.functions.aggregates import SET_TO_ROW, SET_TO_SET, aggregate
from lodestrand.functions.timeutil import now_ns
from lodestrand.operators import series as S
from lodestrand.operators.common import col

from .catalog import Catalog, full_name, matches, series_type, split_name, tags_match
from . import errors as E
from .errors import StatementError
from .parser import Item, Select

_NEGATIVE = {"key", "path"}


@dataclass
class Relation:
    df: DataFrame
    ordered: list[tuple[str, bool]] = field(default_factory=list)
    #: The sources of a scan, if none of its series is in two of them, so that each can be aggregated on its own.
    parts: list[DataFrame] = field(default_factory=list)

    @property
    def keyed(self) -> bool:
        return "key" in self.df.columns

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != "key"]

    def kinds(self) -> dict[str, str]:
        return {f.name: series_type(f.dataType) for f in self.df.schema if f.name != "key"}

    def find(self, pattern: str, tags=None) -> list[str]:
        """Columns of a path, its tagged variants included, in sorted order."""
        out = []
        for n in sorted(self.names):
            path, own = split_name(n)
            if (n == pattern or matches(pattern, path)) and tags_match(tags, own):
                out.append(n)
        return out


def compare(left: Column, op: str, right: Column, text: tuple[bool, bool]) -> Column:
    if text[0] != text[1]:
        return F.lit(False)
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def condition(where, rel: Relation, place=lambda p: p) -> Column:
    """A filter tree as a column.  A path with wildcards holds if every column it names is non-null and fits."""
    op = where[0]
    if op in ("and", "or"):
        out = condition(where[1][0], rel, place)
        for w in where[1][1:]:
            c = condition(w, rel, place)
            out = out & c if op == "and" else out | c
        return out
    if op == "not":
        return ~condition(where[1], rel, place)
    if op == "key":
        if not rel.keyed:
            return F.lit(False)
        return compare(F.col("key"), where[1], F.lit(where[2]), (False, isinstance(where[2], str)))
    kinds = rel.kinds()
    if op == "paths":
        out = F.lit(True)
        lefts, rights = rel.find(place(where[1])), rel.find(place(where[3]))
        if not lefts or not rights:
            return F.lit(False)
        for a in lefts:
            for b in rights:
                out = out & compare(col(a), where[2], col(b), (kinds[a] == "BINARY", kinds[b] == "BINARY"))
        return out
    names = rel.find(place(where[1]))
    if not names:
        return F.lit(False)
    out = F.lit(True)
    for n in names:
        if op == "like":
            out = out & (col(n).rlike(rf"\A(?:{where[2]})\z") if kinds[n] == "BINARY" else F.lit(False))
        elif where[3] is None:
            out = out & F.lit(False)
        else:
            out = out & compare(col(n), where[2], F.lit(where[3]), (kinds[n] == "BINARY", isinstance(where[3], str)))
    return out


def _paths(where) -> list[str]:
    if where is None or where[0] == "key":
        return []
    if where[0] in ("and", "or"):
        return [p for w in where[1] for p in _paths(w)]
    if where[0] == "not":
        return _paths(where[1])
    return [where[1], where[3]] if where[0] == "paths" else [where[1]]


def _leaves(expr) -> list[tuple]:
    if expr[0] in ("path", "call"):
        return [expr]
    return [leaf for part in expr[1:] if isinstance(part, tuple) for leaf in _leaves(part)]


class Planner:
    def __init__(self, catalog: Catalog, functions: U.Registry):
        self.catalog, self.functions = catalog, functions

    def query(self, q: Select, by_key: bool = True) -> DataFrame:
        """The result in its stated order, else by key, or in none if by_key is False: a sort of a large result is a shuffle of its own."""
        rel = self.plan(q)
        order = rel.ordered or ([("key", False)] if rel.keyed and by_key else [])
        return rel.df.orderBy(*[col(n).desc() if d else col(n).asc() for n, d in order]) if order else rel.df

    # --- sources
    def source(self, q: Select, wanted: list[str]) -> tuple[Relation, object]:
        if q.inner is not None:
            return self.plan(q.inner), lambda p: p
        if not q.joins:
            place = lambda p: f"{q.prefix}.{p}"
            names = self.catalog.series([place(w) for w in wanted], q.tags)
            return Relation(self.catalog.scan(names), parts=self.catalog.parts(names)), place
        side = lambda p: Relation(S.keyless(self.catalog.scan(self.catalog.series([p + ".*"], q.tags)), p))
        rel, before = side(q.prefix), q.prefix
        for j in q.joins:
            right = side(j.path)
            on = None
            if j.on is not None:
                both = Relation(rel.df.crossJoin(right.df))  # only its columns are looked at
                on = condition(j.on, both)
            rel = Relation(S.join(rel.df, right.df, before, j.path, j.how, on, j.using, j.natural))
            before = j.path
        return rel, lambda p: p

    def kind_of(self, func: str) -> str:
        low = func.lower()
        if low in SET_TO_ROW:
            return "row"
        if low in SET_TO_SET:
            return "set"
        return {"udtf": "each", "udaf": "row", "udsf": "set"}.get(self.functions.get(func).kind, "other")

    def check(self, q: Select) -> str:
        """simple, each, row or set: what the select list does; the mixing rules hold for all of it."""
        calls = [(leaf[1]) for i in q.items if i.kind == "math" for leaf in _leaves(i.expr) if leaf[0] == "call"] + [i.func for i in q.items if i.kind == "call"]
        kinds = {self.kind_of(f) for f in calls}
        if len(kinds) > 1:
            raise StatementError(E.MIXED_FUNCTIONS)
        bare = any(i.kind == "path" for i in q.items) or any(leaf[0] == "path" for i in q.items if i.kind == "math" for leaf in _leaves(i.expr))
        if kinds & {"row", "set"} and bare:
            raise StatementError(E.MIXED_PATHS)
        kind = kinds.pop() if kinds else "simple"
        if q.window and kind != "row":
            raise StatementError(E.WINDOW_WITHOUT_FUNCTION)
        if q.levels and kind != "row":
            raise StatementError("Group by level needs an aggregate function.")
        if q.order and kind in ("row", "set"):
            raise StatementError(E.ORDERED_AGGREGATE)
        return kind

    # --- queries
    def plan(self, q: Select) -> Relation:
        kind = self.check(q)
        wanted = [i.path for i in q.items if i.kind != "math"] + [leaf[-1] for i in q.items if i.kind == "math" for leaf in _leaves(i.expr)] + _paths(q.where)
        rel, place = self.source(q, wanted)
        if q.window and not rel.keyed:
            raise StatementError("a window needs a keyed relation")
        if q.where is not None:
            rel = Relation(rel.df.where(condition(q.where, rel, place)))
        if q.limit is not None and kind == "simple":
            rel = self.limited(rel, q, place)
        if kind == "row":
            out = self.aggregated(q, rel, place)
        elif kind == "set":
            out = self.set_to_set(q, rel, place)
        else:
            out = self.projected(q, rel, place, kind)
        if q.limit is not None and kind != "simple":
            out = self.limited(out, q, place)
        elif q.order and not out.ordered:
            out.ordered = [(self.order_column(q, out, place), q.order[1])]
        if q.alias:
            out = Relation(out.df.select(*[(col(c) if c == "key" else col(c).alias(f"{q.alias}.{c}")) for c in out.df.columns]), [(n if n == "key" else f"{q.alias}.{n}", d) for n, d in out.ordered])
        return out

    def order_column(self, q: Select, rel: Relation, place) -> str:
        if q.order[0] == "key":
            if not rel.keyed:
                raise StatementError("there is no key to order by")
            return "key"
        names = rel.find(place(q.order[0])) or rel.find(q.order[0])
        if len(names) != 1:
            raise StatementError(f"cannot order by {q.order[0]}")
        return names[0]

    def limited(self, rel: Relation, q: Select, place) -> Relation:
        order = [(self.order_column(q, rel, place), q.order[1])] if q.order else [("key", False)] if rel.keyed else []
        df = rel.df.orderBy(*[col(n).desc() if d else col(n).asc() for n, d in order]) if order else rel.df
        return Relation((df.offset(q.offset) if q.offset else df).limit(q.limit), order if q.order else [])

    def renamed(self, name: str, alias: str | None) -> str:
        return full_name(alias, split_name(name)[1]) if alias else name

    def projected(self, q: Select, rel: Relation, place, kind: str) -> Relation:
        """Bare paths, arithmetic and row-to-row functions, in the order of the select list."""
        key = ["key"] if rel.keyed else []
        df, picked = rel.df, []

        def resolve(expr):
            if "*" in expr[-1]:
                raise StatementError("wildcards cannot stand in arithmetic")
            names = rel.find(place(expr[-1]), q.tags)
            if len(names) != 1:
                raise StatementError(f"arithmetic needs one series, {expr[-1]} names {len(names)}")
            return col(names[0]), rel.kinds()[names[0]], names[0]

        if kind == "each":
            if any(i.kind == "math" for i in q.items):
                raise StatementError("row-to-row functions cannot stand in arithmetic")
            entries = {}
            for item in q.items:
                for x in rel.find(place(item.path), q.tags):
                    f = self.functions.get(item.func) if item.kind == "call" else None
                    out = self.renamed(f"{item.func}({x})" if f else x, item.alias)
                    entries.setdefault(out, (out, x, f))
            return Relation(U.row_to_row(rel.df, key, list(entries.values())), [o for o in rel.ordered if o[0] == "key"])
        seen: dict[str, str] = {}
        for item in q.items:
            if item.kind == "math":
                c, _, name = S.arithmetic(item.expr, resolve)
                picked.append(c.alias(item.alias or name))
            else:
                for n in rel.find(place(item.path), q.tags):
                    out = self.renamed(n, item.alias)
                    seen.setdefault(n, out)
                    if not any(out == x for x in seen.values() if x is not out):
                        picked.append(col(n).alias(out))
        ordered = [(seen.get(n, n), d) for n, d in rel.ordered if n == "key" or n in seen]
        if q.order and not rel.ordered and q.order[0] != "key":
            by = self.order_column(q, rel, place)
            return Relation(df.orderBy(col(by).desc() if q.order[1] else col(by).asc()).select(*key, *picked), [(seen[by], q.order[1])] if by in seen else [])
        return Relation(df.select(*key, *picked), ordered)

    def calls(self, q: Select) -> list[tuple[str, str]]:
        out = []
        for i in q.items:
            out += [(leaf[1], leaf[2]) for leaf in _leaves(i.expr)] if i.kind == "math" else [(i.func, i.path)]
        return list(dict.fromkeys(out))

    def aggregated(self, q: Select, rel: Relation, place) -> Relation:
        """All aggregates of a query in one grouping, with or without windows; arithmetic on top of them."""
        kinds = rel.kinds()
        # aggregates of single series, and what is made of them
        pieces: dict[tuple[str, str], tuple[str, Column]] = {}
        made: dict[str, Column] = {}
        of_call: dict[tuple[str, str], list[str]] = {}
        python: list[tuple[U.Registered, list[str], list[str]]] = []

        def piece(func: str, n: str, native=None) -> Column:
            name = pieces.setdefault((func, n), (f"_p{len(pieces)}", native(col(n)) if native else aggregate(func, n, kinds[n])))[0]
            return F.col(name)

        for func, path in self.calls(q):
            names, low = rel.find(place(path), q.tags), func.lower()
            if low not in SET_TO_ROW:
                own = self.functions.get(func)
                outputs = [f"{func}({n})" for n in names]
                if own.native:
                    made |= {o: piece(func, n, own.native) for n, o in zip(names, outputs, strict=True)}
                else:
                    python.append((own, names, outputs))
            elif q.levels:
                groups: dict[str, list[str]] = {}
                for n in names:
                    groups.setdefault(S.level_path(split_name(n)[0], q.levels), []).append(n)
                outputs = [f"{low}({g})" for g in groups]
                made |= {f"{low}({g})": S.level_total(low, members, piece) for g, members in groups.items()}
            else:
                outputs = [f"{low}({n})" for n in names]
                if low in ("first_value", "last_value") and not rel.keyed:
                    raise StatementError(f"{low} needs a keyed relation")
                made |= {f"{low}({n})": piece(low, n) for n in names}
            of_call[func, path] = outputs
        base = rel.df
        out = None
        if q.window:
            w = q.window
            base = S.hopping(base, w.start, w.end, w.width, w.slide) if w.slide else S.tumbling(base, w.start, w.end, w.width)
            if made or not python:
                out = S.downsample(base, dict(pieces.values()))
        elif made and len(rel.parts) > 1:
            # sources without a common series need not be brought together by key: one row of each
            for part in rel.parts:
                own = [c.alias(p) for (_, n), (p, c) in pieces.items() if n in part.columns]
                if own:
                    row = part.agg(*own)
                    out = row if out is None else out.crossJoin(row)
        elif made:
            out = base.agg(*[c.alias(p) for p, c in pieces.values()])
        if out is not None:
            out = out.select(*(["key"] if q.window else []), *[c.alias(n) for n, c in made.items()])
        for r, names, outputs in python:
            part = U.set_to_row(base, r, names, outputs, S.BUCKET if q.window else None)
            part = part.withColumnRenamed(S.BUCKET, "key") if q.window else part
            out = part if out is None else out.join(part, "key") if q.window else out.crossJoin(part)  # one row each
        if out is None:
            out = rel.df.sparkSession.createDataFrame([], "key bigint" if q.window else "`_none` int")
        picked = ["key"] if q.window else []
        whole = Relation(out)

        def resolve(expr):
            names = of_call[expr[1], expr[2]]
            if len(names) != 1:
                raise StatementError(f"arithmetic needs one series, {expr[2]} names {len(names)}")
            return col(names[0]), whole.kinds()[names[0]], names[0]

        for i in q.items:
            if i.kind == "math":
                c, _, name = S.arithmetic(i.expr, resolve)
                picked.append(c.alias(i.alias or name))
            else:
                picked += [col(o).alias(self.renamed(o, i.alias) if not i.alias else full_name(i.alias, split_name(o[o.index("(") + 1 : -1])[1])) for o in of_call[i.func, i.path]]
        return Relation(out.select(*picked))

    def set_to_set(self, q: Select, rel: Relation, place) -> Relation:
        calls = self.calls(q)
        if all(f.lower() in SET_TO_SET for f, _ in calls):
            if not rel.keyed:
                raise StatementError("first and last need a keyed relation")
            points = [(f.lower(), n) for f, p in calls for n in rel.find(place(p), q.tags)]
            return Relation(S.end_points(rel.df, list(dict.fromkeys(points))), [("key", False), ("path", False)])
        if len(calls) > 1:
            raise StatementError("one set-to-set function at a time")
        func, path = calls[0]
        names = rel.find(place(path), q.tags)
        alias = q.items[0].alias
        return Relation(U.set_to_set(rel.df, self.functions.get(func), names, [self.renamed(f"{func}({n})", alias) for n in names]))


def key_ranges(where) -> list[tuple[int, int]]:
    """The closed key ranges of a delete condition; only key comparisons joined by AND, OR and NOT are allowed."""
    least, most = -(2**63), 2**63 - 1

    def both(a, b):
        return [(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if max(x[0], y[0]) <= min(x[1], y[1])]

    def other(ranges):
        out, at = [], least
        for low, high in sorted(ranges):
            if low > at:
                out.append((at, low - 1))
            at = max(at, high + 1)
        return out + ([(at, most)] if at <= most else [])

    def walk(w):
        if w[0] == "and":
            out = [(least, most)]
            for p in w[1]:
                out = both(out, walk(p))
            return out
        if w[0] == "or":
            return [r for p in w[1] for r in walk(p)]
        if w[0] == "not":
            return other(walk(w[1]))
        if w[0] != "key":
            raise StatementError(E.DELETE_BY_VALUE)
        op, v = w[1], w[2]
        if op == "!=":
            raise StatementError(E.DELETE_NOT_EQUAL)
        return [{"=": (v, v), "<": (least, v - 1), "<=": (least, v), ">": (v + 1, most), ">=": (v, most)}[op]]

    found = walk(where) if where is not None else [(least, most)]
    if not found:
        raise StatementError(E.DELETE_NOTHING)
    return found


__all__ = ["Item", "Planner", "Relation", "condition", "key_ranges", "now_ns"]
