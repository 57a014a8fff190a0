"""Schemas that drift between files: report every change of a column and read all files into one table.

Columns that only one of two consecutive files has are profiled over all rows of their file by mergeable sketches: a
min-hash signature of the values and the moments of their numbers and lengths.  A maximum-weight bipartite matching over the
likeness of sketches, types and names pairs those that went with those that came; where the files share keys, the values at
them decide which pairs are possible at all.  Matched columns are renames, the rest is added or removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, ensure_checkpoint_dir, floor_div

# Spellings of one type.
SAME_TYPE = {"INTEGER": "INT32", "BIGINT": "INT64", "VARCHAR": "BYTE_ARRAY"}
#: Types in order of width; a column holding several has the widest, and text if a BOOLEAN meets another type.
WIDTH = ("INT32", "INT64", "FLOAT", "DOUBLE")
#: Hash orders of a min-hash signature.
HASHES = 16
#: Weights of the likeness of distributions, of value sets, of types and of names, and the total from which columns without shared keys are one.
WEIGHTS, ENOUGH = {"spread": 0.5, "values": 0.3, "type": 0.15, "name": 0.3}, 0.7
#: Files whose ids are broadcast: two numbers each.
FILE_IDS = 200_000
#: Files of a data set that are put in order together; a data set of any size is cut into such stretches.
STRETCH = 1024


def canonical_type(name):
    upper = F.upper(F.trim(name))
    out = upper
    for spelling, same in SAME_TYPE.items():
        out = F.when(upper == spelling, same).otherwise(out)
    return out


def readable_files(headers: DataFrame) -> DataFrame:
    """(dataset, seq_no, file_id, names, types): files with a header; of copies the one with the smallest file_id."""
    kept = headers.where("dataset is not null and seq_no is not null and file_id is not null and col_names is not null and col_types is not null")
    held = kept.groupBy("dataset", "seq_no").agg(F.min_by(F.struct("file_id", "col_names", "col_types"), "file_id").alias("f"))
    return held.select("dataset", "seq_no", F.col("f.file_id").alias("file_id"), F.col("f.col_names").alias("names"), F.transform("f.col_types", canonical_type).alias("types"))


def consecutive_files(files: DataFrame) -> DataFrame:
    """Each file but a data set's first with the columns old_id, old_names, old_types of the readable one before it.

    Stretches of seq_no are ordered on their own; the last file of the nearest earlier stretch is carried in.
    """
    cut = files.withColumn("stretch", floor_div(F.col("seq_no").cast("long"), STRETCH))
    this = F.struct("file_id", "names", "types")
    inside = Window.partitionBy("dataset", "stretch").orderBy("seq_no")
    own = cut.withColumn("before", F.lag(this).over(inside))
    ends = cut.groupBy("dataset", "stretch").agg(F.max_by(this, "seq_no").alias("end"))
    carried = ends.select("dataset", "stretch", F.lag("end").over(Window.partitionBy("dataset").orderBy("stretch")).alias("carried"))
    old = own.join(carried, ["dataset", "stretch"]).withColumn("old", F.coalesce("before", "carried"))
    return old.where("old is not null").select("dataset", "seq_no", "file_id", "names", "types", F.col("old.file_id").alias("old_id"), F.col("old.names").alias("old_names"), F.col("old.types").alias("old_types"))


def _likeness(a: str, b: str) -> float:
    """Share of common letter pairs of two names, regardless of case."""
    pairs = [{s.lower()[i : i + 2] for i in range(len(s) - 1)} for s in (a, b)]
    return 2 * len(pairs[0] & pairs[1]) / max(1, len(pairs[0]) + len(pairs[1]))


def best_matching(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of positive weight with the greatest total, by successive best augmenting paths."""
    if not weight or not weight[0]:
        return []
    n, m = len(weight), len(weight[0])
    row_of, col_of = [-1] * m, [-1] * n
    while True:
        # longest augmenting path by relaxation: gain[j] = best change of the total that ends by taking column j
        gain, via = [float("-inf")] * m, [-1] * m
        for i in range(n):
            if col_of[i] < 0:
                for j in range(m):
                    if weight[i][j] > 0 and weight[i][j] > gain[j]:
                        gain[j], via[j] = weight[i][j], i
        for _ in range(m):
            changed = False
            for j in range(m):
                i = row_of[j]
                if i >= 0 and gain[j] > float("-inf"):
                    for k in range(m):
                        if k != j and weight[i][k] > 0 and gain[j] - weight[i][j] + weight[i][k] > gain[k] + 1e-12:
                            gain[k], via[k], changed = gain[j] - weight[i][j] + weight[i][k], i, True
            if not changed:
                break
        free = [j for j in range(m) if row_of[j] < 0 and gain[j] > 1e-12]
        if not free:
            return sorted((i, j) for j, i in enumerate(row_of) if i >= 0)
        j = max(free, key=lambda j: gain[j])
        while j >= 0:
            i = via[j]
            row_of[j], col_of[i], j = i, j, col_of[i]


def compare_columns(old: dict, new: dict, evidence: dict[tuple[int, int], dict]) -> list[tuple[str, str, str]]:
    """Changes from old to new; both map a name to (position, type), evidence has the likeness of two positions and what their shared keys say."""
    gone, come = [c for c in old if c not in new], [c for c in new if c not in old]

    def weight(a: str, b: str) -> float:
        (i, s), (j, t) = old[a], new[b]
        seen = evidence.get((i, j))
        if seen is None or "BOOLEAN" in (s, t) or seen["shared"] > seen["equal"]:
            return 0.0
        alike = WEIGHTS["spread"] * seen["spread"] + WEIGHTS["values"] * seen["common"] + WEIGHTS["type"] * (s == t or (s in WIDTH and t in WIDTH) / 2) + WEIGHTS["name"] * _likeness(a, b)
        # equal values at the shared keys, one at least not null, prove a rename; without them the likeness has to be enough
        return 1.0 + alike if seen["known"] else alike if alike >= ENOUGH and not seen["shared"] else 0.0

    renamed = [(gone[i], come[j]) for i, j in best_matching([[weight(a, b) for b in come] for a in gone])]
    left, right = {a for a, _ in renamed}, {b for _, b in renamed}
    out = [("renamed", a, b) for a, b in renamed]
    out += [("removed", a, "") for a in gone if a not in left] + [("added", "", b) for b in come if b not in right]
    return out + [("retyped", a, b) for a, b in [*renamed, *((c, c) for c in old if c in new)] if old[a][1] != new[b][1]]


def _compare_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def columns(names, types):
        out: dict = {}
        for i, (n, t) in enumerate(zip(names, types, strict=False)):
            if n is not None:
                out.setdefault(n, (i, t))
        return out

    for pdf in batches:
        found = []
        for f, names, types, old_names, old_types, evidence in zip(pdf["file_id"], pdf["names"], pdf["types"], pdf["old_names"], pdf["old_types"], pdf["evidence"], strict=True):
            seen = {} if evidence is None else {(r["i"], r["j"]): r for r in evidence}
            found += [(f, *c) for c in compare_columns(columns(old_names, old_types), columns(names, types), seen)]
        yield pd.DataFrame(found, columns=["file_id", "change", "old_col", "new_col"])


def number(cell):
    """A cell as a number, null if it is none; words such as NaN and marks of width are no numbers."""
    return F.when(~cell.rlike("[A-Za-z]$"), cell.try_cast("double"))


def candidate_pairs(pairs: DataFrame) -> DataFrame:
    """(file_id, old_id, i, j): positions of a column that only the old file has and of one that only the new file has."""
    lost = lambda own, kinds, other: F.array_compact(F.transform(own, lambda n, i: F.when(~F.array_contains(other, n) & (F.get(kinds, i) != "BOOLEAN"), i)))
    each = pairs.select("file_id", "old_id", lost("old_names", "old_types", F.col("names")).alias("gone"), lost("names", "types", F.col("old_names")).alias("come"))
    return each.select("file_id", "old_id", "come", F.explode("gone").alias("i")).select("file_id", "old_id", "i", F.explode("come").alias("j"))


def column_sketches(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, position, sketch) of the wanted (file_id, positions), over all rows of a file.

    Each part of a sketch is a minimum or a sum, so that those of parts of a file merge into that of the file; tasks send one
    sketch per column.  Null cells take no part.
    """
    cells = rows.join(wanted, "file_id").select("file_id", F.inline(F.transform("positions", lambda p: F.struct(p.alias("position"), F.get("cells", p).alias("cell"))))).where("cell is not null")
    typed = cells.select("file_id", "position", F.xxhash64("cell").alias("h"), number(F.col("cell")).alias("x"), F.length("cell").cast("double").alias("size"))
    # exclusive or with a fixed number is another order of the hashes
    orders = [F.min(F.col("h").bitwiseXOR(F.xxhash64(F.lit(k)))) for k in range(HASHES)]
    moments = [F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.count("x").alias("numbers"), F.count(F.lit(1)).alias("n"), F.avg("size").alias("size"), F.stddev_pop("size").alias("size_deviation")]
    return typed.groupBy("file_id", "position").agg(F.array(*orders).alias("least"), *moments).select("file_id", "position", F.struct("least", *[c for c in ("mean", "deviation", "numbers", "n", "size", "size_deviation")]).alias("sketch"))


def _alike(a: str, b: str):
    """(likeness of value sets, likeness of distributions) of two sketches, from 0 to 1; 0 without values."""
    of = lambda s, c: F.col(f"{s}.{c}")
    common = F.size(F.filter(F.zip_with(of(a, "least"), of(b, "least"), lambda x, y: x == y), lambda same: same)) / F.lit(float(HASHES))

    def near(mean, deviation):
        width = of(a, deviation) + of(b, deviation)
        gap = F.abs(of(a, mean) - of(b, mean))
        low, high = F.least(of(a, deviation), of(b, deviation)), F.greatest(of(a, deviation), of(b, deviation))
        return F.when(width == 0, F.when(gap == 0, 1.0).otherwise(0.0)).otherwise(F.exp(-gap / F.greatest(width, F.lit(1e-300))) * F.sqrt(low / F.greatest(high, F.lit(1e-300))))

    numeric = (2 * of(a, "numbers") > of(a, "n")) & (2 * of(b, "numbers") > of(b, "n"))
    plain = (2 * of(a, "numbers") <= of(a, "n")) & (2 * of(b, "numbers") <= of(b, "n"))
    spread = F.when(numeric, near("mean", "deviation")).when(plain, near("size", "size_deviation")).otherwise(0.0)
    return F.coalesce(common, F.lit(0.0)), F.coalesce(spread, F.lit(0.0))


def column_changes(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, change, old_col, new_col): added, removed, renamed and retyped columns of each readable file.

    A file is compared with the readable one before it by seq_no.  Files without a header are skipped, of copies the
    smallest file_id counts, null names are no columns and a repeated name counts once.  A rename needs equal values at all keys the two
    files share (null only where the other is; texts are equal if their numbers are), or, where they share none, sketches, types and names
    that are alike enough.  BOOLEAN columns are never renamed.
    """
    ensure_checkpoint_dir(headers.sparkSession)
    pairs = consecutive_files(readable_files(headers)).checkpoint()  # put in order once: one row for each file
    candidates = candidate_pairs(pairs)
    both = F.array(F.struct(F.col("old_id").alias("at"), F.col("i").alias("position"), F.lit(True).alias("is_old")), F.struct(F.col("file_id").alias("at"), F.col("j").alias("position"), F.lit(False).alias("is_old")))
    sides = candidates.select("file_id", "i", "j", F.inline(both))
    wanted = sides.groupBy(F.col("at").alias("file_id")).agg(F.collect_set("position").alias("positions"))
    kept = rows.where("cells is not null and file_id is not null").select("file_id", "rec_key", "cells")
    sketches = column_sketches(kept.drop("rec_key"), broadcast_if_small(wanted, FILE_IDS))
    # rows at the keys that two consecutive files share, for files with candidates only
    linked = kept.join(broadcast_if_small(candidates.select("file_id", "old_id").distinct(), FILE_IDS), "file_id")
    olds = candidates.select(F.col("old_id").alias("file_id")).distinct()
    before = kept.join(broadcast_if_small(olds, FILE_IDS), "file_id").select(F.col("file_id").alias("old_id"), "rec_key", F.col("cells").alias("old_cells"))
    shared = linked.join(before, ["old_id", "rec_key"]).select("file_id", "cells", "old_cells")
    a, b = F.get("old_cells", F.col("i")), F.get("cells", F.col("j"))
    same = F.coalesce(a.eqNullSafe(b) | (number(a) == number(b)), F.lit(False))
    told = shared.join(candidates.select("file_id", "i", "j"), "file_id").groupBy("file_id", "i", "j").agg(F.count(F.lit(1)).alias("shared"), F.count_if(same).alias("equal"), F.max(same & a.isNotNull()).alias("known"))
    common, spread = _alike("old_sketch", "new_sketch")
    of = lambda is_old: F.max(F.when(F.col("is_old") == is_old, F.col("sketch")))
    met = sides.join(sketches.withColumnRenamed("file_id", "at"), ["at", "position"], "left").groupBy("file_id", "i", "j").agg(of(True).alias("old_sketch"), of(False).alias("new_sketch"))
    none = F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("equal", F.lit(0)).alias("equal"), F.coalesce("known", F.lit(False)).alias("known")
    evidence = met.join(told, ["file_id", "i", "j"], "left").groupBy("file_id").agg(F.collect_list(F.struct("i", "j", common.alias("common"), spread.alias("spread"), *none)).alias("evidence"))
    full = pairs.join(evidence, "file_id", "left").select("file_id", "names", "types", "old_names", "old_types", "evidence")
    return full.mapInPandas(_compare_batches, "file_id bigint, change string, old_col string, new_col string")


def following(items: DataFrame, links: DataFrame) -> DataFrame:
    """items(dataset, name, place, ...) with found: of links(dataset, name, place, link) of the same name that of the least greater place, null if there is none.

    Stretches of places are put in order on their own; the first link of the nearest later stretch is carried in, so that no data set or name is one task's work.
    """
    both = items.withColumn("_link", F.lit(False)).unionByName(links.withColumn("_link", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("stretch", floor_div(F.col("place").cast("long"), STRETCH))
    keys = ["dataset", "name", "stretch"]
    # from the greatest place down; a link at an item's own place comes after the item
    down = Window.partitionBy(*keys).orderBy(F.col("place").desc(), "_link").rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("_near", F.last("link", ignorenulls=True).over(down)).where("not _link").drop("link", "_link")
    heads = both.groupBy(*keys).agg(F.min_by("link", F.when(F.col("_link"), F.col("place"))).alias("_first"))
    later = Window.partitionBy("dataset", "name").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*keys, F.last("_first", ignorenulls=True).over(later).alias("_later"))
    return inside.join(carried, keys).withColumn("found", F.coalesce("_near", "_later")).drop("_near", "_later", "stretch")


def final_names(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(dataset, file_id, position, name, type, column): the last name under which each column of each file goes on.

    Renames are links in time; their ends are found by pointer doubling over the renames alone.
    """
    spark = files.sparkSession
    ensure_checkpoint_dir(spark)
    place = files.select("dataset", "seq_no", "file_id")
    links = changes.where("change = 'renamed'").join(place, "file_id").select("dataset", F.col("seq_no").alias("place"), F.col("old_col").alias("old"), F.col("new_col").alias("new")).checkpoint()
    chained = following(links.withColumn("name", F.col("new")), links.select("dataset", F.col("old").alias("name"), "place", F.struct("place").alias("link")))
    state = chained.select("dataset", F.col("place").alias("at"), "old", F.col("new").alias("end"), F.col("found.place").alias("next_at")).checkpoint()
    while state.where("next_at is not null").limit(1).count():
        step = state.select("dataset", F.col("at").alias("next_at"), F.col("old").alias("end"), F.col("end").alias("end2"), F.col("next_at").alias("next2"))
        state = state.join(step, ["dataset", "next_at", "end"], "left").select("dataset", "at", "old", F.coalesce("end2", "end").alias("end"), F.col("next2").alias("next_at")).checkpoint()
    columns = files.select("dataset", F.col("seq_no").alias("place"), "file_id", F.posexplode(F.arrays_zip("names", "types")).alias("position", "c")).select("dataset", "place", "file_id", "position", F.col("c.names").alias("name"), F.col("c.types").alias("type")).where("name is not null")
    ends = state.select("dataset", F.col("old").alias("name"), F.col("at").alias("place"), F.struct("end").alias("link"))
    return following(columns, ends).select("dataset", "file_id", "position", "name", "type", F.coalesce("found.end", "name").alias("column"))


def unify(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """One table of all readable files: (dataset, file_id, row_no, rec_key, column, col_type, cell), one type per column."""
    files = readable_files(headers)
    named = final_names(files, column_changes(headers, rows))
    rank = F.array_position(F.array(*[F.lit(t) for t in WIDTH]), F.col("type"))
    kinds = named.groupBy("dataset", "column").agg(F.min("type").alias("low"), F.max("type").alias("high"), F.min(rank).alias("narrowest"), F.max(rank).alias("widest"))
    numeric = F.element_at(F.array(*[F.lit(t) for t in WIDTH]), F.greatest(F.col("widest"), F.lit(1)).cast("int"))
    typed = kinds.select("dataset", "column", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("narrowest") > 0, numeric).otherwise("BYTE_ARRAY").alias("col_type"))
    by_file = named.join(typed, ["dataset", "column"]).groupBy("dataset", "file_id").agg(F.collect_list(F.struct("position", "column", "col_type")).alias("columns"))
    wide = rows.join(by_file, "file_id").select("dataset", "file_id", "row_no", "rec_key", "cells", F.inline("columns"))
    return wide.select("dataset", "file_id", "row_no", "rec_key", "column", "col_type", F.get("cells", F.col("position")).alias("cell"))
