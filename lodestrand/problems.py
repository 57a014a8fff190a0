"""Queries of the general data problems (p1 to p6) over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import digest as D
from .operators import drift as S
from .operators import grid as G
from .operators import rolling as R
from .operators.common import DAY_NS, floor_div, table
from .operators.points import SHARD_SLOTS, sharded_points
from .operators.records import holding_values, record_cells
from .operators.spikes import SHARD_SLOTS as SPIKE_SLOTS
from .operators.spikes import implausible
from .operators.timestamps import apply_offsets, infer_offsets, normalise_points

# --- p1 -------------------------------------------------------------------------------------------------------------
P1_PERIODS = {**R.TRAILING, "old": (29, 23)}


def _p1_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = record_cells(table(spark, sf_dir, "records")).where("data_type = 'LONG'")
    daily = R.daily_totals(holding_values(cells).withColumn("day_no", floor_div(F.col("rec_key"), DAY_NS)), "series", "day_no", "val")
    return R.trailing_totals(daily, P1_PERIODS).withColumnsRenamed({"entity": "series", "day": "day_no"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lull = F.col("n_7") == 0
    surge = (F.col("n_old") >= 1) & (2 * F.col("total_7") > F.col("total_30"))
    kinds = F.filter(F.array(F.when(lull, "lull"), F.when(surge, "surge")), lambda k: k.isNotNull())
    return _p1_trailing(spark, sf_dir).select("series", "day_no", F.explode(kinds).alias("kind"))


def p1_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1_trailing(spark, sf_dir).select("series", "day_no", "total_7", "n_7", F.round("avg_7", 6).alias("avg_7"), "total_30", "n_30", F.round("avg_30", 6).alias("avg_30"))


_P1_CTE = f"""
with cell as (select record_id, rec_key, unnest(measurements) series, unnest(data_types) data_type, unnest(vals) val from records where rec_key <> -1),
held as (select series, rec_key, arg_max(val, record_id) val from cell where data_type = 'LONG' and val is not null and not isnan(val) group by all),
daily as (select series, cast((rec_key - ((rec_key % {DAY_NS}) + {DAY_NS}) % {DAY_NS}) // {DAY_NS} as integer) day_no, sum(val) total, count(*) n from held group by all),
cal as (select series, unnest(range(min(day_no), max(day_no) + 1))::integer day_no from daily group by series),
roll as (select c.series, c.day_no,
  coalesce(sum(d.total) filter (d.day_no > c.day_no - 7), 0) total_7, count(d.n) filter (d.day_no > c.day_no - 7) d7, coalesce(sum(d.n) filter (d.day_no > c.day_no - 7), 0)::bigint n_7,
  coalesce(sum(d.total), 0) total_30, coalesce(sum(d.n), 0)::bigint n_30, count(d.n) filter (d.day_no <= c.day_no - 23) n_old
  from cal c left join daily d on d.series = c.series and d.day_no between c.day_no - 29 and c.day_no group by all)
"""
P1_SQL = {
    "p1_found": _P1_CTE + "select series, day_no, 'lull' kind from roll where n_7 = 0 union all select series, day_no, 'surge' from roll where n_old >= 1 and 2 * total_7 > total_30",
    "p1_rolling": _P1_CTE + "select series, day_no, total_7, n_7, round(total_7 / 7, 6) avg_7, total_30, n_30, round(total_30 / 30, 6) avg_30 from roll",
}

# --- p2 -------------------------------------------------------------------------------------------------------------
P2_PROBS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
_MEDIAN, _P90 = P2_PROBS.index(0.5), P2_PROBS.index(0.9)


def _p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = record_cells(table(spark, sf_dir, "records"), [("data_center", F.col("tags")["data_center"])]).where(F.col("series").endswith(".s4"))
    held = holding_values(cells, ["data_center"]).where("data_center is not null")
    # the filter holds always; said here, both passes over the values filter alike and share the shuffle
    return held.select("data_center", floor_div(F.col("rec_key"), DAY_NS).cast("int").alias("day_no"), "val").where("day_no is not null")


def _p2_estimates(values: DataFrame) -> DataFrame:
    """One row per data centre and day: the day's estimates (day) and those of all its days (whole)."""
    daily = D.digest(values, ["data_center", "day_no"], "val")
    whole = D.digest_percentiles(D.merge_digests(daily, ["data_center"]), ["data_center"], P2_PROBS, "whole").drop("n_values")
    return D.digest_percentiles(daily, ["data_center", "day_no"], P2_PROBS, "day").drop("n_values").join(whole, "data_center")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose median lies above the estimated bound, decided by counting: fewer than half of a day's values lie up to it."""
    values = _p2_values(spark, sf_dir)
    bounds = _p2_estimates(values).select("data_center", "day_no", F.col("whole")[_P90].alias("bound"))
    counted = D.count_ranks(values, ["data_center", "day_no"], "val", bounds, ["bound"])
    return counted.where(2 * F.col("upto_bound") < F.col("n")).select("data_center", "day_no")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every percentile of every day (and of all days, day_no null): the estimate, and the share of ranks by which the counting pass found it to miss."""
    values = _p2_values(spark, sf_dir)
    keys = ["data_center", "day_no"]
    day, whole = [f"day{i}" for i in range(len(P2_PROBS))], [f"whole{i}" for i in range(len(P2_PROBS))]
    bounds = _p2_estimates(values).select(*keys, *[F.col("day")[i].alias(c) for i, c in enumerate(day)], *[F.col("whole")[i].alias(c) for i, c in enumerate(whole)])
    counted = D.count_ranks(values, keys, "val", bounds, day + whole)

    def listed(df: DataFrame, columns: list[str], day_no) -> DataFrame:
        each = [F.struct(F.lit(float(p)).alias("prob"), F.col(c).alias("estimate"), D.rank_error(p, c).alias("error")) for p, c in zip(P2_PROBS, columns, strict=True)]
        return df.select("data_center", day_no.alias("day_no"), "n", F.inline(F.array(*each)))

    sums = [F.sum("n").alias("n"), *[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in whole for k in ("below", "upto")]]
    return listed(counted, day, F.col("day_no")).unionAll(listed(counted.groupBy("data_center", *whole).agg(*sums), whole, F.lit(None).cast("int")))


def p2_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_percentiles without the estimates; certified: counted to be within the stated share of ranks, or one rank."""
    return p2_percentiles(spark, sf_dir).select("data_center", "day_no", "n", "prob", (F.col("error") * F.col("n") <= F.greatest(F.lit(1.0), D.RANK_ERROR * F.col("n"))).alias("certified"))


_P2_CTE = f"""
with cell as (select record_id, rec_key, tags['data_center'] data_center, unnest(measurements) series, unnest(vals) val from records where rec_key <> -1),
held as (select series, rec_key, arg_max({{'v': val, 'dc': data_center}}, record_id) w from cell where series like '%.s4' and val is not null and not isnan(val) group by all),
kept as (select w.dc data_center, cast(rec_key // {DAY_NS} as integer) day_no, w.v val from held where w.dc is not null)
"""
P2_SQL = {
    "p2_found": _P2_CTE + """, whole as (select data_center, quantile_cont(val, 0.9) bound from kept group by 1)
select data_center, day_no from kept join whole using (data_center) group by data_center, day_no, bound having median(val) > bound""",
    "p2_certified": _P2_CTE + f""", probs as (select unnest({list(P2_PROBS)}) prob)
select data_center, day_no, n, prob::double prob, true certified from (select data_center, day_no, count(*) n from kept group by grouping sets ((data_center, day_no), (data_center))), probs""",
}

# --- p3 -------------------------------------------------------------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_points(table(spark, sf_dir, "raw_points"), table(spark, sf_dir, "feeds")).select("raw_id", "rec_key")


#: Planted clocks: a device's quarter hours east of UTC by its last letter, and one hour more from 2025-06-20T01:00Z on.
_TURN_S = 1_750_381_200
_EAST = "((ascii(right(device, 1)) % 23) - 11) * 3600 + (ascii(right(device, 1)) % 4) * 900"
#: Records that a device needs on either side of the change to be listed.
_SIDES_N = 20


def p3_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of planted device clocks, found by aligning their local times with the times of arrival alone.

    Per device with enough records on both sides of the change: its first and last offset, the number of its records, and whether 95 % of their instants are restored.
    """
    at = F.col("rec_key").cast("long")
    kept = table(spark, sf_dir, "records").where("device is not null and rec_key > 0 and recv_at is not null").select("device", floor_div(at, 1_000_000_000).alias("true_s"), F.unix_seconds(F.col("recv_at").cast("timestamp_ltz")).alias("recv_s"))
    clocks = kept.withColumn("local_s", F.col("true_s") + F.expr(_EAST).cast("long") + F.when(F.col("true_s") >= _TURN_S, 3600).otherwise(0))
    offsets = infer_offsets(clocks, "device", "local_s", "recv_s", max_lag_s=900)
    history = offsets.groupBy(F.col("source").alias("device")).agg(F.min_by("offset_s", "period").alias("first_offset_s"), F.max_by("offset_s", "period").alias("last_offset_s"))
    late = F.count_if(F.col("true_s") >= _TURN_S)
    restored = apply_offsets(clocks, "device", "local_s", offsets, most_violations=0.5).groupBy("device").agg(F.count(F.lit(1)).alias("n"), late.alias("late"), F.count_if(F.col("utc_s") == F.col("true_s")).alias("right"))
    enough = (F.col("late") >= _SIDES_N) & (F.col("n") - F.col("late") >= _SIDES_N)
    return restored.where(enough).join(history, "device").select("device", "first_offset_s", "last_offset_s", "n", (F.col("right") >= 0.95 * F.col("n")).alias("restored"))


P3_SQL = {
    "p3_inferred": f"""select device, ({_EAST})::bigint first_offset_s, ({_EAST})::bigint + 3600 last_offset_s, count(*) n, true restored from records where device is not null and rec_key > 0 and recv_at is not null
group by device having count_if(rec_key // 1000000000 >= {_TURN_S}) >= {_SIDES_N} and count_if(rec_key // 1000000000 < {_TURN_S}) >= {_SIDES_N}""",
}

# --- p4 -------------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str, limits: bool = False) -> DataFrame:
    return sharded_points(table(spark, sf_dir, "metric_batches"), table(spark, sf_dir, "metric_catalog"), SPIKE_SLOTS if limits else SHARD_SLOTS, limits)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.regular_grid(_points(spark, sf_dir), missing_only=True).select("metric_name", "host", "slot_s")


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.regular_grid(_points(spark, sf_dir)).select("metric_name", "host", "slot_s", "reading", "n_readings", "is_missing", "carried")


_POINTS_CTE = """
with post as (select batch_id, metric_name, tags['host'] host, unnest(datapoints) p from metric_batches where tags['host'] is not null),
pt as (select metric_name, host, p.ts_ms ts_ms, arg_max(p.reading, batch_id) reading from post where p.reading is not null and not isnan(p.reading) group by all)
"""
_GRID_CTE = _POINTS_CTE + """,
slot as (select metric_name, host, step_s, (ts_ms // 1000) // step_s * step_s slot_s, arg_max(reading, ts_ms) reading, count(*) n_readings from pt join metric_catalog using (metric_name) group by all),
grid as (select metric_name, host, unnest(range(min(slot_s), max(slot_s) + 1, any_value(step_s)::bigint)) slot_s from slot group by 1, 2)
"""
P4_SQL = {
    "p4_found": _GRID_CTE + "select metric_name, host, slot_s from grid anti join slot using (metric_name, host, slot_s)",
    "p4_grid": _GRID_CTE + """select metric_name, host, slot_s, reading, coalesce(n_readings, 0) n_readings, n_readings is null is_missing,
last_value(reading ignore nulls) over (partition by metric_name, host order by slot_s) carried from grid left join slot using (metric_name, host, slot_s)""",
}

# --- p5 -------------------------------------------------------------------------------------------------------------


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(_points(spark, sf_dir, limits=True))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_flags(spark, sf_dir).select("metric_name", "host", "ts_ms")


# --- p6 -------------------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.column_changes(table(spark, sf_dir, "file_headers"), table(spark, sf_dir, "file_rows"))


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unify(table(spark, sf_dir, "file_headers"), table(spark, sf_dir, "file_rows"))


_TYPE = "case upper(trim({0})) when 'INTEGER' then 'INT32' when 'BIGINT' then 'INT64' when 'VARCHAR' then 'BYTE_ARRAY' else upper(trim({0})) end"
_DRIFT_CTE = f"""
with recursive f as (select dataset, seq_no, min(file_id) file_id from file_headers where col_names is not null group by all),
p as (select file_id, lag(file_id) over (partition by dataset order by seq_no) old_id from f),
c as (select file_id, unnest(col_names) n, {_TYPE.format("unnest(col_types)")} t, unnest(range(len(col_names))) i from file_headers where col_names is not null),
v as (select r.file_id, r.rec_key, c.n, r.cells[c.i + 1] x from file_rows r join c using (file_id)),
gone as (select p.file_id, p.old_id, n, t from p join c on c.file_id = p.old_id where not exists (from c d where d.file_id = p.file_id and d.n = c.n)),
come as (select p.file_id, p.old_id, n, t from p join c using (file_id) where p.old_id is not null and not exists (from c d where d.file_id = p.old_id and d.n = c.n)),
ren as (select g.file_id, g.n old_col, h.n new_col, g.t old_t, h.t new_t from gone g join come h using (file_id) join v a on a.file_id = g.old_id and a.n = g.n join v b on b.file_id = g.file_id and b.n = h.n and b.rec_key = a.rec_key
  where g.t <> 'BOOLEAN' and h.t <> 'BOOLEAN' group by all having bool_and(coalesce(a.x = b.x or try_cast(a.x as double) = try_cast(b.x as double), false)))"""
P6_SQL = {
    "p6_found": _DRIFT_CTE + """
select file_id, 'renamed' change, old_col, new_col from ren
union all select file_id, 'retyped', old_col, new_col from ren where old_t <> new_t
union all select p.file_id, 'retyped', a.n, a.n from p join c a on a.file_id = p.old_id join c b on b.file_id = p.file_id and a.n = b.n where a.t <> b.t
union all select file_id, 'removed', n, '' from gone where (file_id, n) not in (select file_id, old_col from ren)
union all select file_id, 'added', '', n from come where (file_id, n) not in (select file_id, new_col from ren)""",
    "p6_unified": _DRIFT_CTE + """,
link as (select dataset, seq_no at_no, old_col, new_col from ren join f using (file_id)),
chained as (select l.*, (select min(m.at_no) from link m where m.dataset = l.dataset and m.old_col = l.new_col and m.at_no > l.at_no) next_no from link l),
walk as (select dataset, at_no, old_col, new_col last_col, next_no from chained
  union all select w.dataset, w.at_no, w.old_col, l.new_col, l.next_no from walk w join chained l on l.dataset = w.dataset and l.at_no = w.next_no and l.old_col = w.last_col),
ends as (select dataset, at_no, old_col, last_col from walk where next_no is null),
named as (select f.dataset, f.file_id, c.n, c.t, c.i, coalesce((select arg_min(e.last_col, e.at_no) from ends e where e.dataset = f.dataset and e.old_col = c.n and e.at_no > f.seq_no), c.n) as "column" from f join c using (file_id)),
kinds as (select dataset, "column", min(t) low_t, max(t) high_t, list_position(['INT32', 'INT64', 'FLOAT', 'DOUBLE'], t) w from named group by dataset, "column", t),
typed as (select dataset, "column", case when min(low_t) = max(high_t) then min(low_t) when bool_and(w is not null) then (['INT32', 'INT64', 'FLOAT', 'DOUBLE'])[max(w)] else 'BYTE_ARRAY' end col_type from kinds group by 1, 2)
select dataset, n.file_id, r.row_no, r.rec_key, n."column", col_type, r.cells[n.i + 1] cell from named n join typed using (dataset, "column") join file_rows r on r.file_id = n.file_id""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_rolling, p2_found, p2_percentiles, p2_certified, p3_found, p3_inferred, p4_found, p4_grid, p5_found, p5_flags, p6_found, p6_unified)}
SQL = {**P1_SQL, **P2_SQL, **P3_SQL, **P4_SQL, **P6_SQL}
