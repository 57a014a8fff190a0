"""Filling containers of fixed capacity with whole items.

Sizes are whole tokens, so an instance of any number of items is a histogram of at most capacity sizes.  On it the
dominance rules of the bin-packing reduction fix containers that no packing can better: two items that fill a container
exactly, an item that fits with nothing, and an item with its largest partner where no two others beside it come to more.
The rest goes by best fit in decreasing order, a whole size class at a time.  The plan, a list of container patterns with
their numbers, is then applied to the items by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.common import broadcast_if_small, ensure_checkpoint_dir

from .encode import pieces_of
from .units import TOKENIZERS, cut, tokenizer

#: Items of one size that a task ranks; a larger class is cut into so many more places.
RANKED = 100_000
#: Units of which a task remembers the count, per tokenizer.
REMEMBERED = 1_000_000


def _count(names: Sequence[str], folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {n: tokenizer(n, folder) for n in names}
        known: dict[str, dict[str, int]] = {n: {} for n in names}
        for batch in batches:
            for part in pieces_of(batch, "text"):
                forms, codes, counts = cut(part.column("text"))
                used, codes = np.unique(codes, return_inverse=True)
                row = np.repeat(np.arange(len(counts)), counts)
                out = [part.column("doc_id")]
                for n in names:
                    memory, count = known[n], own[n].count
                    if len(memory) > REMEMBERED:
                        memory.clear()
                    each = np.zeros(len(used), np.int64)
                    for i, u in enumerate(used.tolist()):
                        f = forms[u]
                        c = memory.get(f)
                        if c is None:
                            c = memory[f] = count(f)
                        each[i] = c
                    out.append(pa.array(np.bincount(row, each[codes], len(counts)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *names])

    return run


def count_tokens(docs: DataFrame, names: Sequence[str], folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, one column of token counts per tokenizer); 0 for null and empty texts.  Narrow: nothing is shuffled."""
    shape = "doc_id bigint, " + ", ".join(f"`{n}` bigint" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count(names, folder), shape)


def _dominating(left: dict[int, int], order: list[int], s: int, capacity: int) -> int | None:
    """The item that beside one of size s dominates every other filling of its container: a size, 0 for none at all, None if no single item does.

    left: items of each size; order: its sizes, sorted.
    """
    room = capacity - s
    others = lambda t: left[t] - (t == s)
    end = bisect_right(order, room)
    while end and not others(order[end - 1]):
        end -= 1
    if not end:
        return 0
    best = order[end - 1]
    if best == room:
        return best
    smallest: list[int] = []
    for t in order[:4]:
        if t <= room:
            smallest += [t] * min(3, others(t))
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return best
    if len(smallest) > 2 and sum(smallest[:3]) <= room:
        return None
    # two others fit at most: the largest sum of two by moving in from both ends
    i, j, most = 0, end - 1, 0
    while i <= j:
        a, b = order[i], order[j]
        if not others(a):
            i += 1
        elif not others(b) or a + b > room or (i == j and others(a) < 2):
            j -= 1
        else:
            most, i = max(most, a + b), i + 1
    return best if most <= best else None


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing can do with less of: large items take one each, what room they leave takes the others at best."""
    size, n = (np.array(c, np.int64) for c in zip(*sorted((s, n) for s, n in histogram.items() if n > 0), strict=True)) if any(histogram.values()) else (np.zeros(0, np.int64),) * 2
    items, tokens = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(size * n)]
    upto = lambda s: np.searchsorted(size, s, side="right")  # noqa: E731  sizes up to s
    k = np.r_[0, size[2 * size <= capacity]]
    large, middle = upto(capacity - k), upto(capacity // 2)  # beyond large: nothing of size k fits beside
    half_n, half = items[large] - items[middle], tokens[large] - tokens[middle]
    rest = tokens[middle] - tokens[upto(k - 1)]
    extra = np.maximum(0, -(-(rest - (capacity * half_n - half)) // capacity))
    return int(np.max(items[-1] - items[large] + half_n + extra))


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """(patterns, containers fixed by dominance); a pattern is (number of containers, {size: items in each})."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    fixed: list[tuple[int, dict[int, int]]] = []

    def fix(n: int, pattern: dict[int, int]) -> None:
        fixed.append((n, pattern))
        for s, k in pattern.items():
            left[s] -= n * k
            if not left[s]:
                del left[s]
                order.pop(bisect_left(order, s))

    order = sorted(left)
    for s in sorted(left, reverse=True):
        t = capacity - s
        if s in left and t in left and t < s:
            fix(min(left[s], left[t]), {s: 1, t: 1})
        elif t == s and left.get(s, 0) > 1:
            fix(left[s] // 2, {s: 2})
    # an item is fixed with the largest partner if no two others beside it come to more; as long as any item is
    again = True
    while again:
        again = False
        for s in sorted(left, reverse=True):
            while s in left and (partner := _dominating(left, order, s, capacity)) is not None:
                if partner == 0:
                    fix(left[s], {s: 1})
                elif partner == s:
                    fix(left[s] // 2, {s: 2})
                else:
                    fix(min(left[s], left[partner]), {s: 1, partner: 1})
                again = True
    by_dominance = sum(n for n, _ in fixed)
    # best fit, decreasing: groups of equal containers by their free room
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []  # those of groups, sorted

    def put(room: int, n: int, pattern: dict[int, int]) -> None:
        if n:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((n, pattern))

    for s in sorted(left, reverse=True):
        todo = left[s]
        while todo and (i := bisect_left(rooms, s)) < len(rooms):
            room = rooms[i]
            n, pattern = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            t = room // s
            full = min(n, todo // t)
            rest = todo - full * t if full < n else 0
            put(room - t * s, full, {**pattern, s: t})
            if rest:
                put(room - rest * s, 1, {**pattern, s: rest})
            put(room, n - full - (rest > 0), pattern)
            todo -= full * t + rest
        t = capacity // s
        put(capacity - t * s, todo // t, {s: t})
        if todo % t:
            put(capacity - todo % t * s, 1, {s: todo % t})
    return fixed + [g for room in rooms for g in groups[room]], by_dominance


def _pieces(sizes: DataFrame) -> DataFrame:
    """Items of a spec: an item over the capacity is cut into full containers and a rest, no other is cut."""
    last = F.call_function("div", F.col("n_tokens") - 1, F.col("capacity"))
    each = sizes.where("n_tokens > 0 and capacity > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("piece_no") * F.col("capacity")
    return each.select("spec_id", "capacity", "doc_id", "row_no", "piece_no", first.alias("first_token"), F.least(F.col("capacity"), F.col("n_tokens") - first).alias("size"))


def pack(docs: DataFrame, specs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, first_token, n_tokens): where each item, or piece of one, goes.

    specs(spec_id, tokenizer, capacity) is read to the driver; more than 1000 specs are refused.  Texts without tokens
    (null, empty) take no part.  Equal texts and rows with equal doc_id are items of their own.  container_id counts from 1 in each spec.
    """
    return pack_with_report(docs, specs, folder)[0]


def pack_with_report(docs: DataFrame, specs: DataFrame, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """pack() and, per spec, the numbers of containers planned and fixed by dominance, and the bound below which none can be: (spec_id, planned, by_dominance, at_least)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    wanted = specs.where("spec_id is not null and tokenizer is not null and capacity > 0").select("spec_id", "tokenizer", "capacity").limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("more than 1000 packing specs")
    report = "spec_id int, planned bigint, by_dominance bigint, at_least bigint"
    if not wanted:
        return spark.createDataFrame([], "spec_id int, container_id bigint, doc_id bigint, piece_no bigint, first_token bigint, n_tokens bigint"), spark.createDataFrame([], report)
    counted = count_tokens(docs, sorted({w["tokenizer"] for w in wanted}), folder)
    each = [F.struct(F.lit(w["spec_id"]).cast("int").alias("spec_id"), F.lit(w["capacity"]).cast("long").alias("capacity"), F.col(w["tokenizer"]).alias("n_tokens")) for w in wanted]
    # counted once, then planned and placed from the written table; rows may share a doc_id, so each has a number of its own
    items = _pieces(counted.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.inline(F.array(*each))).checkpoint())
    # at most one row for each size up to the capacity
    histogram = items.groupBy("spec_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    by_spec: dict[tuple[int, int], dict[int, int]] = {}
    for h in histogram:
        by_spec.setdefault((h["spec_id"], h["capacity"]), {})[h["size"]] = h["n"]
    rows, classes, reports = [], [], []
    for (spec, capacity), sizes in by_spec.items():
        used, container = dict.fromkeys(sizes, 0), 1
        patterns, fixed = plan_containers(sizes, capacity)
        for n, pattern in patterns:
            for size, k in pattern.items():
                rows.append((spec, size, used[size], used[size] + n * k, container, k))
                used[size] += n * k
            container += n
        classes += [(spec, size, -(-n // RANKED)) for size, n in sizes.items()]
        reports.append((spec, container - 1, fixed, lower_bound(sizes, capacity)))
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["spec_id", "size", "low", "high", "container", "k"]), "spec_id int, size bigint, low bigint, high bigint, container bigint, k bigint")
    # at most one row for each size and spec
    places = F.broadcast(spark.createDataFrame(pd.DataFrame(classes, columns=["spec_id", "size", "places"]), "spec_id int, size bigint, places int"))
    salted = items.join(places, ["spec_id", "size"]).withColumn("salt", F.pmod(F.xxhash64("row_no", "piece_no"), F.col("places")).cast("int"))
    shares = salted.groupBy("spec_id", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = shares.select("spec_id", "size", "salt", (F.sum("n").over(Window.partitionBy("spec_id", "size").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("spec_id", "size", "salt").orderBy("doc_id", "piece_no"))
    ranked = salted.withColumn("own", own).join(before, ["spec_id", "size", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    placed = ranked.join(broadcast_if_small(plan, 100_000), ["spec_id", "size"]).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    container = F.col("container") + F.call_function("div", F.col("rank") - F.col("low"), F.col("k"))
    out = placed.select("spec_id", container.alias("container_id"), "doc_id", "piece_no", "first_token", F.col("size").alias("n_tokens"))
    return out, spark.createDataFrame(pd.DataFrame(reports, columns=["spec_id", "planned", "by_dominance", "at_least"]), report)
