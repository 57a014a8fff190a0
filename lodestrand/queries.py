"""Queries of the series engine over the driver's tables, and the same in plain SQL."""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.udf import Registered
from .operators import rest as R
from .operators.common import col, table
from .operators.curve import curve_match
from .session import Session
from .transform import apply_transformer

DAY = 86_400_000_000_000
#: An end beyond any key, for windows over a whole table.
END = 2**62


_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}


def open_session(spark: SparkSession, sf_dir: str, statement: str = "FROM events") -> Session:
    """The driver's tables that a statement names as series: events keyed by event_id (events) and by time (ev), the others by their keys."""
    s = Session(spark, by_key=False)
    named = lambda prefix: "FROM *" in statement or re.search(rf"\b{prefix}\b", statement)
    t = lambda name: table(spark, sf_dir, name)
    if named("events"):
        s.register(t("events").select("event_id", "user_id", "event_type", "value"), "events", "event_id")
    if named("ev"):
        s.register(t("events").select((F.unix_micros(F.col("ts").cast("timestamp_ltz")) * 1000).alias("key"), "value", "user_id"), "ev")
    for name, key in _KEYS.items():
        if not named(name):
            continue
        df = t(name)
        s.register(df.select(F.col(key).cast("long").alias("key"), *[c for c in df.columns]), name)
    return s


QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, statement: str, columns: str, sql: str | None, rounded: str = "") -> None:
    """A query given as a statement of the engine; columns names its output in order, rounded lists columns to round."""
    names, places = columns.split(), set(rounded.split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = open_session(spark, sf_dir, statement).execute(statement)
        return df.select(*[(F.round(col(c), 4) if n in places else col(c)).alias(n) for c, n in zip(df.columns, names, strict=True)])

    run.__name__, run.__doc__ = name, statement
    QUERIES[name] = run
    if sql:
        SQL[name] = textwrap.dedent(sql)


def _numeric(of: str = "value", k: str = "event_id") -> dict[str, str]:
    return {
        "count": f"count({of})", "sum": f"round(coalesce(sum({of}), 0), 4)", "avg": f"round(coalesce(avg({of}), 'nan'::double), 4)", "max": f"max({of})", "min": f"min({of})",
        "first_value": f"arg_min({of}, {k}) filter ({of} is not null)", "last_value": f"arg_max({of}, {k}) filter ({of} is not null)",
    }


_AGG = _numeric()
_ALL = ", ".join(f"{f}(value)" for f in _AGG)
_NAMES = " ".join(f"{f}_v" for f in _AGG)
_SEL = ", ".join(f"{e} {f}_v" for f, e in _AGG.items())
_R = "sum_v avg_v"

# 2.2 projection
add("project_prefix", "SELECT value, user_id FROM events", "key value user_id", "select event_id as key, value, user_id from events")
add("rename_alias", "SELECT value AS v, user_id AS u FROM events AS r", "key r_v r_u", "select event_id as key, value r_v, user_id r_u from events")
add("reorder_columns", "SELECT * FROM supplier", "key s_acctbal s_name s_nationkey s_suppkey", "select s_suppkey as key, s_acctbal, s_name, s_nationkey, s_suppkey from supplier")
# 2.3 filters
add("filter_key_range", "SELECT value FROM events WHERE key >= 100 AND 2000 > key", "key value", "select event_id as key, value from events where event_id >= 100 and event_id < 2000")
add("filter_value", "SELECT value, event_type FROM events WHERE value > 50.5 AND event_type = 'click'", "key value event_type", "select event_id as key, value, event_type from events where value > 50.5 and event_type = 'click'")
add("filter_or_key_value", "SELECT value FROM events WHERE key < 10 OR value > 200", "key value", "select event_id as key, value from events where event_id < 10 or value > 200")
add("filter_path_pair", "SELECT value FROM events WHERE value > user_id", "key value", "select event_id as key, value from events where value > user_id")
add("filter_not", "SELECT value FROM events WHERE !(value > 10 OR user_id < 50)", "key value", "select event_id as key, value from events where not (value > 10 or user_id < 50)")
add("filter_regex", "SELECT event_type FROM events WHERE event_type LIKE '^[cv].*'", "key event_type", "select event_id as key, event_type from events where regexp_full_match(event_type, '^[cv].*')")
add("filter_wildcard", "SELECT value FROM ev WHERE * > 10", "key value", "select epoch_us(ts) * 1000 as key, value from events where value > 10 and user_id > 10")
# 2.5 aggregates
for f, e in _AGG.items():
    add(f"agg_{f}", f"SELECT {f}(value) FROM events", f"{f}_v", f"select {e} {f}_v from events", f"{f}_v" if f in ("sum", "avg") else "")
add("agg_all", f"SELECT {_ALL} FROM events", _NAMES, f"select {_SEL} from events", _R)
add("agg_empty_input", "SELECT sum(value), avg(value), count(value), max(value) FROM events WHERE key < 0", "s a c m", "select 0.0::double s, 'nan'::double a, 0::bigint c, null::double m")
add("agg_text", "SELECT max(event_type), min(event_type) FROM events", "hi lo", "select max(event_type) hi, min(event_type) lo from events")
add("group_by_level", "SELECT sum(*nationkey), count(*nationkey), avg(*nationkey) FROM * GROUP BY LEVEL = 2", "total n mean", """
    select sum(k)::bigint total, count(k) n, round(avg(k), 4) mean from (select c_nationkey k from customer union all select s_nationkey from supplier union all select n_nationkey from nation)""", "mean")
# 2.6 first, last
add("first_points", "SELECT first(value), first(user_id) FROM events WHERE key >= 7", "key path value", """
    select event_id as key, 'events.value' path, cast(value as varchar) as value from events where event_id = 7 union all select event_id, 'events.user_id', cast(user_id as varchar) from events where event_id = 7""")
add("last_points", "SELECT last(value), last(user_id) FROM events", "key path value", """
    with m as (select max(event_id) k from events) select k as key, 'events.value' path, cast(value as varchar) as value from events, m where event_id = k union all select k, 'events.user_id', cast(user_id as varchar) from events, m where event_id = k""")
# 2.7 windows
add("downsample_tumbling", f"SELECT {_ALL} FROM ev GROUP [2024-01-01, 2024-06-30) BY 1d", "key " + _NAMES, f"""
    with e as (select epoch_us(ts) * 1000 k, value from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-06-30')
    select k - (k - epoch_us(timestamp '2024-01-01') * 1000) % {DAY} as key, {", ".join(f"{e.replace('event_id', 'k')} {f}_v" for f, e in _AGG.items())} from e group by 1""", _R)
# windows up to an end beyond any key
for f, e in _AGG.items():
    add(f"downsample_tumbling_{f}_whole", f"SELECT {f}(value) FROM events GROUP [0, {END}) BY 250ns", f"key {f}_v", f"select event_id - event_id % 250 as key, {e} {f}_v from events where event_id >= 0 group by 1", f"{f}_v" if f in ("sum", "avg") else "")
add("downsample_hopping_whole", f"SELECT count(value), sum(value), max(value) FROM events GROUP [100, {END}) BY 500ns SLIDE 200ns", "key n s m", """
    with w as (select 100 + 200 * i b from (select unnest(range(0, (select max(event_id) from events) // 200 + 1)) i)) select b as key, count(value) n, round(sum(value), 4) s, max(value) m from w join events on event_id >= b and event_id < b + 500 group by b""", "s")
add("downsample_hopping_gaps_whole", f"SELECT count(value), max(value) FROM events GROUP [100, {END}) BY 500ns SLIDE 700ns", "key n m", """
    with w as (select 100 + 700 * i b from (select unnest(range(0, (select max(event_id) from events) // 700 + 1)) i)) select b as key, count(value) n, max(value) m from w join events on event_id >= b and event_id < b + 500 group by b""")
add("downsample_filtered_whole", f"SELECT max(value) FROM events WHERE value < 20 GROUP [0, {END}) BY 100ns", "key m", "select event_id - event_id % 100 as key, max(value) m from events where value < 20 and event_id >= 0 group by 1")
add("downsample_bounds_whole", f"SELECT count(value) FROM events GROUP (100, {END}] BY 100ns", "key n", "select event_id - (event_id - 101) % 100 as key, count(value) n from events where event_id > 100 group by 1")
add("downsample_level_whole", f"SELECT count(*) FROM events GROUP [0, {END}) BY 1000ns, LEVEL = 0", "key n", "select event_id - event_id % 1000 as key, count(value) + count(user_id) + count(event_type) n from events where event_id >= 0 group by 1")
add("arith_over_downsample_whole", f"SELECT max(value) - min(value) FROM events GROUP [0, {END}) BY 500ns", "key d", "select event_id - event_id % 500 as key, max(value) - min(value) d from events where event_id >= 0 group by 1")
add("subquery_nested_agg_whole", f"SELECT max(m) FROM (SELECT avg(value) AS m FROM events GROUP [0, {END}) BY 100ns)", "top", "select round(max(m), 4) top from (select avg(value) m from events where event_id >= 0 group by event_id // 100)", "top")
add("downsample_limit", f"SELECT max(value) FROM events GROUP [0, {END}) BY 100ns LIMIT 5 OFFSET 3", "key m", "select event_id - event_id % 100 as key, max(value) m from events where event_id >= 0 group by 1 order by 1 limit 5 offset 3")
# 2.8 expressions
add("arith_basic", "SELECT value + 1, value - user_id, value * 2.5, -value FROM events", "key a b c d", "select event_id as key, value + 1 a, value - user_id b, value * 2.5::double c, -value d from events")
add("arith_intdiv_mod", "SELECT user_id / 7, user_id % 7, (user_id + 3) * 2 FROM events", "key a b c", "select event_id as key, user_id // 7 a, user_id % 7 b, (user_id + 3) * 2 c from events")
add("arith_double_zero_whole", "SELECT value / 0.0, value % 0.0 FROM events", "key a b", "select event_id as key, case when value > 0 then 'infinity'::double when value < 0 then '-infinity'::double else 'nan'::double end a, 'nan'::double b from events")
add("arith_over_aggregate", "SELECT max(value) - min(value) FROM events", "d", "select max(value) - min(value) d from events")
# 2.9 sort and limit
add("limit_offset", "SELECT value FROM events LIMIT 20 OFFSET 50", "key value", "select event_id as key, value from events order by 1 limit 20 offset 50")
add("limit_pair", "SELECT value FROM events LIMIT 7, 5", "key value", "select event_id as key, value from events order by 1 limit 5 offset 7")
add("sort_key_desc", "SELECT value FROM events ORDER BY KEY DESC LIMIT 10", "key value", "select event_id as key, value from events order by 1 desc limit 10")
add("sort_path", "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC", "key p", "select o_orderkey as key, o_totalprice p from orders")
# 2.10 subqueries
add("subquery_filter", "SELECT v FROM (SELECT value AS v, user_id AS u FROM events WHERE value > 5) WHERE v < 10 AND u > 20", "key v", "select event_id as key, value v from events where value > 5 and value < 10 and user_id > 20")
# 2.4 joins
_JOIN = "SELECT supplier.s_name, supplier.key, nation.n_name, nation.key FROM supplier {} nation ON supplier.s_nationkey = nation.n_nationkey"
_JOIN_SQL = "select s_name s, s_suppkey sk, n_name n, n_nationkey::bigint nk from supplier {} join nation on s_nationkey = n_nationkey"
for how, word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT OUTER JOIN"), ("full", "FULL JOIN")):
    add(f"join_{how}", _JOIN.format(word), "s sk n nk", _JOIN_SQL.format(how))
add("join_cross", "SELECT nation.n_name, region.r_name FROM nation CROSS JOIN region", "n r", "select n_name n, r_name r from nation, region")
add("join_comma_where", "SELECT nation.n_name, region.r_name FROM nation, region WHERE nation.n_regionkey = region.r_regionkey", "n r", "select n_name n, r_name r from nation join region on n_regionkey = r_regionkey")
add("join_theta", "SELECT nation.n_name, region.r_name FROM nation JOIN region ON nation.n_regionkey < region.r_regionkey AND nation.n_nationkey > region.r_regionkey", "n r", "select n_name n, r_name r from nation join region on n_regionkey < r_regionkey and n_nationkey > r_regionkey")
add("join_chain", "SELECT supplier.s_name, nation.n_name, region.r_name FROM supplier JOIN nation ON supplier.s_nationkey = nation.n_nationkey LEFT JOIN region ON nation.n_regionkey = region.r_regionkey", "s n r", "select s_name s, n_name n, r_name r from supplier join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")


def _whole_sides(spark: SparkSession, sf_dir: str) -> Session:
    """Prefixes a and b with shared column names, for USING and NATURAL joins: users by their clicks and by their views, each with at least one above a value."""
    s, ev = Session(spark, by_key=False), table(spark, sf_dir, "events")
    clicks, views = (ev.where(F.col("event_type") == kind).groupBy("user_id") for kind in ("click", "view"))
    s.register(clicks.agg(F.max("event_id").alias("key"), F.round(F.sum("value"), 2).alias("v"), F.max("value").alias("_top")).where("_top > 150").drop("_top"), "a")
    s.register(views.agg(F.max("event_id").alias("key"), F.count(F.lit(1)).alias("n"), F.max("value").alias("_top")).where("_top > 150").drop("_top"), "b")
    return s


_WHOLE_SIDES = "with a as (select user_id, max(event_id) k, round(sum(value), 2) v from events where event_type = 'click' group by 1 having max(value) > 150), b as (select user_id, max(event_id) k, count(*) n from events where event_type = 'view' group by 1 having max(value) > 150) "


def add_sides(name: str, clause: str, sql_join: str, keep: str, sides, sql_sides: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sides(spark, sf_dir).execute(f"SELECT * FROM a {clause}")
        return df.select(col(f"{keep}.user_id").alias("user_id"), col("a.key").alias("ak"), col("a.v").alias("v"), col("b.key").alias("bk"), col("b.n").alias("n"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = sql_sides + f"select {keep}.user_id, a.k ak, v, b.k bk, n from a {sql_join} join b on a.user_id = b.user_id"


add_sides("join_using_whole", "JOIN b USING user_id", "inner", "a", _whole_sides, _WHOLE_SIDES)
add_sides("join_natural_whole", "NATURAL JOIN b", "inner", "a", _whole_sides, _WHOLE_SIDES)
add_sides("join_natural_left_whole", "NATURAL LEFT JOIN b", "left", "a", _whole_sides, _WHOLE_SIDES)
add_sides("join_natural_right_whole", "NATURAL RIGHT JOIN b", "right", "b", _whole_sides, _WHOLE_SIDES)


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = textwrap.dedent(sql)
        return f

    return wrap


@query("select s_name s, n_name n, n_nationkey nk from supplier join nation on s_nationkey = n_nationkey")
def join_type_cast(spark, sf_dir):
    """A DOUBLE key of one side against an INTEGER key of the other."""
    s = open_session(spark, sf_dir, "FROM nation")
    s.register(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), "s_name", F.col("s_nationkey").cast("double").alias("of")), "d")
    return s.execute("SELECT d.s_name, nation.n_name, nation.n_nationkey FROM d JOIN nation ON d.of = nation.n_nationkey").toDF("s", "n", "nk")


# 2.1 sources, inserts, deletes
@query("""
    select event_id as key, case when event_id < 2000 then value end lo, case when event_id >= 1000 then value end hi from events""")
def union_streams(spark, sf_dir):
    s, ev = Session(spark, by_key=False), table(spark, sf_dir, "events")
    s.register(ev.where("event_id < 2000").select("event_id", F.col("value").alias("lo")), "u", "event_id")
    s.register(ev.where("event_id >= 1000").select("event_id", F.col("value").alias("hi")), "u", "event_id")
    return s.execute("SELECT lo, hi FROM u").toDF("key", "lo", "hi")


@query("""
    select event_id as key, case when event_id % 3 = 0 then value * 2 else value end as value from events""")
def merge_duplicate_keys(spark, sf_dir):
    """Later writes of a key hold, their nulls aside."""
    s, ev = Session(spark, by_key=False), table(spark, sf_dir, "events")
    s.register(ev.select("event_id", "value"), "m", "event_id")
    s.register(ev.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value") * 2).alias("value")), "m", "event_id")
    return s.execute("SELECT value FROM m").toDF("key", "value")


@query("select event_id as key, value from events where event_id % 2 = 0")
def drop_empty_rows(spark, sf_dir):
    s, ev = Session(spark, by_key=False), table(spark, sf_dir, "events")
    s.register(ev.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value")), "m", "event_id")
    return s.execute("SELECT value FROM m").toDF("key", "value")


@query("select event_id + 5 as key, value from events where value < 10")
def insert_select_offset(spark, sf_dir):
    s = open_session(spark, sf_dir)
    s.execute("INSERT INTO copy(key, v) VALUES (SELECT value FROM events WHERE value < 10) TIME_OFFSET = 5")
    return s.execute("SELECT v FROM copy").toDF("key", "value")


@query("select event_id as key, value, user_id from (select event_id, case when event_id > 105 and event_id < 400 or event_id >= 9000 then null else value end as value, user_id from events)")
def delete_range(spark, sf_dir):
    s = open_session(spark, sf_dir)
    s.execute("DELETE FROM events.value WHERE key > 105 AND key < 400 OR key >= 9000")
    return s.execute("SELECT value, user_id FROM events").toDF("key", "value", "user_id")


@query("select 'events.event_type' path, 'BINARY' as type union all select 'events.value', 'DOUBLE'")
def show_time_series(spark, sf_dir):
    s = open_session(spark, sf_dir)
    s.execute("DELETE TIME SERIES events.user_id")
    return s.execute("SHOW TIME SERIES events.*")


@query("select 4 * count(*) as points from supplier")
def count_points(spark, sf_dir):
    s = Session(spark)
    s.register(table(spark, sf_dir, "supplier").withColumn("key", F.col("s_suppkey")), "supplier")
    return s.execute("COUNT POINTS")


@query("""
    select event_id as key, case when event_type = 'click' then value end click, case when event_type = 'view' then value end as view from events where event_type in ('click', 'view')""")
def tags_with(spark, sf_dir):
    s, ev = Session(spark, by_key=False), table(spark, sf_dir, "events")
    for kind in ("click", "view", "error"):
        s.register(ev.where(F.col("event_type") == kind).select("event_id", F.col("value").alias(f"v{{kind={kind},site=x}}")), "t", "event_id")
    s.register(ev.select("event_id", F.col("value").alias("v")), "t", "event_id")
    return s.execute("SELECT v FROM t WITH kind=click OR kind=view AND site=*").toDF("key", "click", "view")


# 2.11 functions and transformers
@query("select event_id as key, round(cos(value), 9) c from events")
def udtf_cos(spark, sf_dir):
    df = open_session(spark, sf_dir).execute("SELECT cos(value) FROM events")
    return df.toDF("key", "c").withColumn("c", F.round("c", 9))


@query("select event_id - event_id % 1000 as key, round(avg(value), 4) a, count(value) n from events where event_id >= 0 group by 1")
def udaf_avg_whole(spark, sf_dir):
    df = open_session(spark, sf_dir).execute(f"SELECT udf_avg(value), udf_count(value) FROM events GROUP [0, {END}) BY 1000ns")
    return df.toDF("key", "a", "n").withColumn("a", F.round("a", 4))


class _AddOne:
    def transform(self, rows):
        return [rows[0]] + [[r[0], r[1] + 1] for r in rows[1:]]


@query("select event_id as key, user_id + 1 u from events")
def transform_stream(spark, sf_dir):
    return apply_transformer(open_session(spark, sf_dir).execute("SELECT user_id FROM events"), _AddOne, "stream").toDF("key", "u")


class _Totals:
    """A batch task: one row of the whole set."""

    def transform(self, rows):
        return [["n", "total"], [len(rows) - 1, sum(r[1] for r in rows[1:])]]


@query("select count(*) n, sum(user_id)::bigint total from events")
def transform_batch(spark, sf_dir):
    return apply_transformer(open_session(spark, sf_dir).execute("SELECT user_id FROM events"), _Totals, "batch").toDF("n", "total")


class _Running:
    """A set-to-set function: the running total in order of the keys."""

    def transform(self, rows):
        total, out = 0, []
        for r in rows:
            total += r[0]
            out.append([total])
        return out


@query("select (sum(user_id) over (order by event_id))::bigint total from events")
def udsf_running(spark, sf_dir):
    s = open_session(spark, sf_dir)
    s.functions.by_name["running"] = Registered("udsf", "running", _Running, returns="bigint")
    return s.execute("SELECT running(user_id) FROM events").toDF("total")


# 2.12 metric aggregators
def _metric(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "value").where("value is not null")


@query("select event_id - event_id % 500 as key, round(var_pop(value), 4) as value from events group by 1")
def rest_dev(spark, sf_dir):
    return R.bucketed(_metric(spark, sf_dir), "dev", 0, 2**62, 500).withColumn("value", F.round("value", 4))


for _f, _e in {"max": "max(value)", "min": "min(value)", "count": "count(value)", "first": "arg_min(value, event_id)", "last": "arg_max(value, event_id)"}.items():

    def _run(spark, sf_dir, f=_f):
        return R.bucketed(_metric(spark, sf_dir), f, 0, 2**62, 500)

    _run.__name__ = f"rest_{_f}"
    QUERIES[f"rest_{_f}"], SQL[f"rest_{_f}"] = _run, f"select event_id - event_id % 500 as key, {_e} as value from events group by 1"


for _f, _e in {"sum": "sum(value)", "avg": "avg(value)"}.items():

    def _run(spark, sf_dir, f=_f):
        return R.bucketed(_metric(spark, sf_dir), f, 0, END, 500).withColumn("value", F.round("value", 4))

    _run.__name__ = f"rest_{_f}"
    QUERIES[f"rest_{_f}"], SQL[f"rest_{_f}"] = _run, f"select event_id - event_id % 500 as key, round({_e}, 4) as value from events group by 1"


@query("select event_id as key, value from events")
def rest_save_as(spark, sf_dir):
    """A metric saved under another name and read back."""
    s = open_session(spark, sf_dir)
    saved = {"name": "save_as", "metric_name": "saved.value"}
    R.query_datapoints(s, {"start_absolute": 0, "end_absolute": END // 10**6, "metrics": [{"name": "events.value", "aggregators": [saved]}]}, 0)
    return s.execute("SELECT value FROM saved").toDF("key", "value")


@query("select event_id as key, round(value - p, 4) as value from (select *, lag(value) over (order by event_id) p from events) where p is not null")
def rest_diff(spark, sf_dir):
    return R.diff(_metric(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query("select event_id as key, round((value - p) * 1000 / (event_id - k), 4) as value from (select *, lag(value) over (order by event_id) p, lag(event_id) over (order by event_id) k from events) where p is not null")
def rest_rate(spark, sf_dir):
    return R.rate(_metric(spark, sf_dir), 1000).withColumn("value", F.round("value", 4))


@query("select event_id as key, round(value * 1000 / (event_id - k), 4) as value from (select *, lag(event_id) over (order by event_id) k from events) where k is not null")
def rest_sampler(spark, sf_dir):
    return R.sampler(_metric(spark, sf_dir), 1000).withColumn("value", F.round("value", 4))


@query("select event_id as key, value / 4 as value from events")
def rest_div(spark, sf_dir):
    return R.div(_metric(spark, sf_dir), 4)


@query("select event_id as key, value from events where value >= 25")
def rest_filter(spark, sf_dir):
    return R.threshold(_metric(spark, sf_dir), "gte", 25)


@query("select key, l[cast(floor(0.9 * (len(l) - 1)) as bigint) + 1] as value from (select event_id - event_id % 500 as key, list_sort(list(value)) l from events group by 1)")
def rest_percentile(spark, sf_dir):
    return R.percentile(_metric(spark, sf_dir), 0.9, 0, 2**62, 500)


@query()
def curve_match_events(spark, sf_dir):
    """Where values rise and fall like the query, among two series."""
    s = open_session(spark, sf_dir)
    df = s.catalog.scan(s.catalog.series(["events.value", "events.user_id"]))
    return curve_match(df, ["events.user_id", "events.value"], [1, 2, 4, 8, 4, 2, 1, 2, 4, 8], 1, 0, 2**62)
