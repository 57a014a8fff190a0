"""Queries of the engine's statements, calls, functions and jobs over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.udf import Registered
from .operators import rest as R
from .operators.common import col, ensure_checkpoint_dir, numbered, table
from .plans.errors import StatementError
from .queries import END, QUERIES, SQL, add, open_session, query
from .session import Session
from .sources import open_source, write_result
from .streaming import register_points, read_messages

DAY = 86_400_000_000_000


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


# filters and dates
add("filter_operators", "SELECT value FROM events WHERE user_id != 7 AND user_id <> 8 AND value <= 100 AND event_type != 'click'", "key value", "select event_id as key, value from events where user_id <> 7 and user_id <> 8 and value <= 100 and event_type <> 'click'")
add("filter_date_arithmetic", "SELECT value FROM ev WHERE key >= 2024-01-10 00:00:00 + 36h AND key < 2024-01-20 - 1d2h", "key value", """
    select epoch_us(ts) * 1000 as key, value from events where ts >= timestamp '2024-01-11 12:00:00' and ts < timestamp '2024-01-18 22:00:00'""")
add("join_left_theta", "SELECT nation.n_name, region.r_name FROM nation LEFT JOIN region ON nation.n_regionkey < region.r_regionkey AND nation.n_nationkey > 10", "n r", "select n_name n, r_name r from nation left join region on n_regionkey < r_regionkey and n_nationkey > 10")


@query("select event_id as key, value + case when event_id % 2 = 1 then user_id end a, case when event_id % 2 = 1 then user_id end * 2 b from events")
def arith_null_operand(spark, sf_dir):
    s = Session(spark, by_key=False)
    s.register(table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") % 2 == 1, F.col("user_id")).alias("odd")), "n", "event_id")
    return s.execute("SELECT value + odd, odd * 2 FROM n").toDF("key", "a", "b")


@query("select min(event_id) as key, 'f.v' path, arg_min(v, event_id)::varchar as value from (select event_id, case when event_id % 5 = 3 then value end v from events) where v is not null")
def first_points_nulls(spark, sf_dir):
    """The first point of a series that begins with nulls."""
    s = Session(spark)
    s.register(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 3, F.col("value")).alias("v")), "f", "event_id")
    return s.execute("SELECT first(v) FROM f")


@query("select row_number() over (order by o_totalprice desc) - 1 as place, o_totalprice p from orders")
def sort_path_places(spark, sf_dir):
    """The place of each row in a result ordered by a path."""
    df = open_session(spark, sf_dir, "FROM orders").execute("SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC")
    return numbered(df.select(col("orders.o_totalprice").alias("p")), "place")


@query("select row_number() over (order by event_id) - 1 as place, value from events where value > 50")
def sort_key_places(spark, sf_dir):
    s = open_session(spark, sf_dir)
    return numbered(s.execute("SELECT value FROM events WHERE value > 50", by_key=True).select(col("events.value").alias("value")), "place")


@query("select * from (values ('key'), ('events.value + 1'), ('- events.value'), ('(events.value × 2)'), ('v')) t(name)")
def output_names(spark, sf_dir):
    df = open_session(spark, sf_dir).execute("SELECT value + 1, -value, (value * 2), user_id AS v FROM events")
    return spark.createDataFrame([(c,) for c in df.columns], "name string")


@query("select * from (values (1630000000000000000, 10, 20, 30), (1630000001500000000, 11, 21, null)) t(\"key\", a, b, c)")
def special_paths(spark, sf_dir):
    """Names of digits, signs and other scripts; a bare number in a select list is a path."""
    s = Session(spark)
    s.execute("INSERT INTO 数据.4711(key, 99, _m:@#$, 温度) VALUES (2021-08-26 17:46:40, 10, 20, 30), (2021/08/26T17:46:41.500, 11, 21, NULL)")
    return s.execute("SELECT 99, _m:@#$, 温度 FROM 数据.4711").toDF("key", "a", "b", "c")


@query("""select * from (values (1, 'wildcards cannot stand in arithmetic'), (2, 'arithmetic needs numbers'), (3, 'a natural join needs columns of one name on both sides'),
(4, 'This clause delete nothing, check your filter again.'), (5, 'a window needs a positive width'), (6, 'unknown function median')) t(no, message)""")
def statement_errors(spark, sf_dir):
    """What is said of statements that cannot be analysed."""
    s, found = open_session(spark, sf_dir, "FROM events nation region"), []
    for text in ("SELECT value + * FROM events", "SELECT event_type + 1 FROM events", "SELECT * FROM nation NATURAL JOIN region", "DELETE FROM events.value WHERE key > 9 AND key < 4", "SELECT max(value) FROM events GROUP [0, 10) BY 0ns", "SELECT median(value) FROM events"):
        try:
            s.execute(text)
            found.append((len(found) + 1, "nothing"))
        except StatementError as e:
            found.append((len(found) + 1, str(e)))
    return spark.createDataFrame(found, "no int, message string")


# statements and calls
@query("select * from (values (1, 1.5, 'p', true), (2, 20.5, null, false), (3, null, 'r', null)) t(\"key\", x, s, b)")
def insert_values(spark, sf_dir):
    s = Session(spark)
    s.execute("INSERT INTO a(key, x, s, b) VALUES (1, 1.5, 'p', true), (2, 2.5, NULL, false), (3, NaN, 'r', NULL); INSERT INTO a(key, x) VALUES (2, 20.5)")
    df = s.execute("SELECT x, s, b FROM a")
    return df.select("key", col("a.x").cast("decimal(3,1)").alias("x"), col("a.s").alias("s"), col("a.b").alias("b"))


@query("select * from (values (1000000, 1, 10, 'u'), (2000000, 2, null, 'w'), (3000000, null, 30, null)) t(\"key\", a, b, c)")
def insert_calls(spark, sf_dir):
    """The four layouts of inserted records."""
    s = Session(spark)
    s.insert_column_records(["i.a", "i.b"], [1, 2], [[1, 2], [10, None]], precision="ms")
    s.insert_row_records(["i.c"], [1], [["u"]], precision="ms")
    s.insert_non_aligned_column_records(["i.b"], [3], [[30]], precision="ms")
    s.insert_non_aligned_row_records(["i.c"], [2], [["w"]], precision="ms")
    return s.query(["i.a", "i.b", "i.c"], 0, 9, precision="ms").toDF("key", "a", "b", "c")


@query("select 0::bigint series, 0::bigint points, 1 added")
def clear_data(spark, sf_dir):
    s = open_session(spark, sf_dir)
    s.execute("CLEAR DATA")
    gone = s.execute("SHOW TIME SERIES").count()
    points = s.execute("COUNT POINTS").first()[0]
    s.execute("INSERT INTO a(key, x) VALUES (1, 1)")
    return spark.createDataFrame([(gone, points, s.execute("SHOW TIME SERIES").count())], "series bigint, points bigint, added int")


@query("select s_suppkey as key, s_name, s_acctbal from supplier where s_acctbal > 100")
def add_storage_engine(spark, sf_dir):
    s = Session(spark, by_key=False)
    s.execute(f'ADD STORAGEENGINE ("127.0.0.1", 0, "parquet", "prefix=sup,key=s_suppkey,path={sf_dir}/supplier.parquet")')
    return s.execute("SELECT s_name, s_acctbal FROM sup WHERE s_acctbal > 100").toDF("key", "s_name", "s_acctbal")


@query("select 1 replicas, 'spark' kind")
def show_cluster(spark, sf_dir):
    s = Session(spark)
    return s.execute("SHOW REPLICA NUMBER").crossJoin(s.execute("SHOW CLUSTER INFO").select("kind"))  # one row each


@query("select event_id as key, case when event_id < 50 or event_id > 60 then value end as value, user_id from events")
def store_round_trip(spark, sf_dir):
    """A session with a folder for its series: inserts and a delete, read again by a second session after compaction."""
    folder = scratch(spark)
    s = open_session(spark, sf_dir).attach(folder)
    s.execute("INSERT INTO kept(key, v, u) VALUES (SELECT value, user_id FROM events); DELETE FROM kept.v WHERE key >= 50 AND key <= 60")
    s.catalog.store.compact()
    return Session(spark, by_key=False).attach(folder).execute("SELECT v, u FROM kept").toDF("key", "value", "user_id")


@query("select event_id as key, value, event_type from events")
def parquet_sink(spark, sf_dir):
    folder = scratch(spark)
    s = open_session(spark, sf_dir)
    s.write(s.execute("SELECT value, event_type FROM events").toDF("key", "value", "event_type"), folder)
    return Session(spark, by_key=False).register(open_source(spark, "parquet", path=folder), "p").execute("SELECT value, event_type FROM p").toDF("key", "value", "event_type").select("key", "value", "event_type")


@query("select event_id as key, value, event_type from events where value is not null")
def csv_round_trip(spark, sf_dir):
    folder = scratch(spark)
    write_result(open_session(spark, sf_dir).execute("SELECT value, event_type FROM events WHERE value > -1000000").toDF("key", "value", "event_type"), folder, "csv")
    return open_source(spark, "csv", path=folder)


def _tagged(spark, sf_dir) -> Session:
    s, ev = Session(spark, by_key=False), table(spark, sf_dir, "events")
    for kind in ("click", "view"):
        s.register(ev.where(F.col("event_type") == kind).select("event_id", F.col("value").alias(f"v{{kind={kind},site=x}}")), "t", "event_id")
    s.register(ev.where("event_type = 'error'").select("event_id", F.col("value").alias("v{kind=error}")), "t", "event_id")
    s.register(ev.select("event_id", F.col("value").alias("v")), "t", "event_id")
    return s


@query("select event_id as key, value from events where event_type = 'error'")
def tags_precise(spark, sf_dir):
    return _tagged(spark, sf_dir).execute("SELECT v FROM t WITH_PRECISE kind=error").toDF("key", "value")


@query("select event_id as key, value from events")
def tags_without(spark, sf_dir):
    return _tagged(spark, sf_dir).execute("SELECT v FROM t WITHOUT TAG").toDF("key", "value")


@query("select event_id as key, case when event_type = 'click' then value end click, case when event_type = 'view' then value end as view from events where event_type in ('click', 'view') and event_id >= 10")
def tags_call(spark, sf_dir):
    return _tagged(spark, sf_dir).query(["t.v"], 10, END, {"kind": ["click", "view"], "site": ["x"]}).toDF("key", "click", "view")


@query("select max(event_id) as key, 'events.value' path, arg_max(value, event_id)::varchar as value from events where event_id >= 100 and value is not null union all select max(event_id), 'events.user_id', arg_max(user_id, event_id)::varchar from events where event_id >= 100 and user_id is not null")
def last_query_call(spark, sf_dir):
    return open_session(spark, sf_dir).last_query(["events.value", "events.user_id"], 100)


@query("""with w as (select 200 * i b from (select unnest(range(0, (select max(event_id) from events) // 200 + 1)) i)) select b as key, max(value) m from w join events on event_id >= b and event_id < b + 500 group by b""")
def downsample_call_slide(spark, sf_dir):
    return open_session(spark, sf_dir).downsample_query(["events.value"], 0, END, "max", 500, 200).toDF("key", "m")


@query("select sum(user_id)::bigint s from events where event_id >= 5")
def aggregate_call(spark, sf_dir):
    return open_session(spark, sf_dir).aggregate_query(["events.user_id"], 5, END, "sum").toDF("s")


# functions and jobs
@query("select event_id as key, round(cos(value), 9) a, round(cos(user_id), 9) b, user_id from events")
def udtf_two(spark, sf_dir):
    df = open_session(spark, sf_dir).execute("SELECT cos(value), cos(user_id), user_id FROM events").toDF("key", "a", "b", "user_id")
    return df.withColumns({"a": F.round("a", 9), "b": F.round("b", 9)})


class _Half:
    """A row-to-row function in Python."""

    def transform(self, row):
        return [None if x is None else x / 2 for x in row]


@query("select s_acctbal / 2 a, n_nationkey / 2 b, s_name n from supplier join nation on s_nationkey = n_nationkey")
def udtf_over_join(spark, sf_dir):
    """Python functions of both sides of a join, without a key; their type is found on a row."""
    s = open_session(spark, sf_dir, "FROM supplier nation")
    s.functions.by_name["half"] = Registered("udtf", "half", _Half)
    return s.execute("SELECT half(supplier.s_acctbal), half(nation.n_nationkey), supplier.s_name FROM supplier JOIN nation ON supplier.s_nationkey = nation.n_nationkey").toDF("a", "b", "n")


class _Count:
    """A set-to-row function in Python with a declared type."""

    returns = "bigint"

    def transform(self, rows):
        return [sum(r[0] is not None for r in rows)]


@query("select event_id - event_id % 1000 as key, count(value) n, min(value) lo, max(value) hi, round(sum(value), 4) s from events group by 1")
def udaf_samples(spark, sf_dir):
    df = open_session(spark, sf_dir).execute(f"SELECT udf_count(value), udf_min(value), udf_max(value), udf_sum(value) FROM events GROUP [0, {END}) BY 1000ns")
    return df.toDF("key", "n", "lo", "hi", "s").withColumn("s", F.round("s", 4))


@query("select round(avg(value), 4) a, count(value) n, min(user_id) lo, sum(user_id)::bigint s from events")
def udaf_global(spark, sf_dir):
    return open_session(spark, sf_dir).execute("SELECT udf_avg(value), udf_count(value), udf_min(user_id), udf_sum(user_id) FROM events").toDF("a", "n", "lo", "s").withColumn("a", F.round("a", 4))


@query("select event_id - event_id % 500 as key, count(value) n from events group by 1")
def udaf_python(spark, sf_dir):
    s = open_session(spark, sf_dir)
    s.functions.by_name["own_count"] = Registered("udaf", "own_count", _Count, returns=_Count.returns)
    return s.execute(f"SELECT own_count(value) FROM events GROUP [0, {END}) BY 500ns").toDF("key", "n")


def _job(name: str, statement: str, tasks: list[str], columns: str, sql: str) -> None:
    """A transform job of a statement and native transformers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = open_session(spark, sf_dir).jobs.build([{"kind": "sql", "sql": [statement]}, *({"kind": "python", "name": t} for t in tasks)])
        return df.toDF(*columns.split())

    run.__name__, run.__doc__ = name, f"{statement}, then {', '.join(tasks)}"
    QUERIES[name], SQL[name] = run, sql


_job("transform_distinct", "SELECT event_type FROM events", ["distinct"], "key event_type", "select min(event_id) as key, event_type from events group by 2")
_job("transform_head", "SELECT value FROM events", ["head"], "key value", "select event_id as key, value from events order by 1 limit 5")
_job("transform_bottom", "SELECT value FROM events", ["bottom"], "key value", "select event_id as key, value from events order by 1 desc limit 1")
_job("transform_sortindex", "SELECT value FROM events", ["sortindex", "head"], "key value", "select event_id as key, value from events order by 1 desc limit 5")
_job("transform_spread", "SELECT value, user_id FROM events", ["spread"], "key a b", """
with e as (select row_number() over (order by event_id) - 1 i, event_id, value, user_id from events)
select max(i) - min(i) as key, arg_max(i, (value, -i)) - arg_min(i, (value, i)) a, arg_max(i, (user_id, -i)) - arg_min(i, (user_id, i)) b from e""")


@query("select round(avg(event_id), 4) k, round(avg(value), 4) v from events")
def transform_mean(spark, sf_dir):
    df = open_session(spark, sf_dir).jobs.build([{"kind": "sql", "sql": ["SELECT value FROM events"]}, {"kind": "python", "name": "mean"}])
    return df.toDF("k", "v").select(F.round("k", 4).alias("k"), F.round("v", 4).alias("v"))


@query("select round(skewness(value), 4) skew from events")
def transform_skew(spark, sf_dir):
    df = open_session(spark, sf_dir).jobs.build([{"kind": "sql", "sql": ["SELECT value FROM events"]}, {"kind": "python", "name": "skew"}])
    return df.select(F.round(col("events.value"), 4).alias("skew"))


@query("select event_id as key, value from events")
def job_file_sink(spark, sf_dir):
    """A job whose rows go to a file, read back."""
    folder, s = scratch(spark), open_session(spark, sf_dir)
    number = s.jobs.commit([{"kind": "sql", "sql": ["SELECT value FROM events"]}], "file", folder)
    if s.jobs.wait(number, 600) != "finished":
        raise RuntimeError(s.jobs.jobs[number]["error"])
    return spark.read.option("header", True).schema("key bigint, value double").csv(folder)


@query("select row_number() over (order by event_id) - 1 as place, value from events")
def job_engine_sink(spark, sf_dir):
    """A job whose rows become series of the engine, with keys of their own in the order of the rows."""
    s = open_session(spark, sf_dir)
    number = s.jobs.commit([{"kind": "sql", "sql": ["SELECT value FROM events"]}], "engine")
    if s.jobs.wait(number, 600) != "finished":
        raise RuntimeError(s.jobs.jobs[number]["error"])
    df = s.execute("SELECT events.value FROM transform", by_key=True)
    return numbered(df.select(col("transform.events.value").alias("value")), "place")


# metrics and messages
@query("select * from (values (1000000000, 1.5), (2000000000, 2.5)) t(\"key\", v)")
def rest_ingest(spark, sf_dir):
    s = Session(spark)
    R.ingest_datapoints(s, [{"name": "m", "tags": {"host": "a"}, "datapoints": [[1000, 1.5], [2000, 2.5]]}, {"name": "n", "timestamp": 5, "value": 7}])
    out = R.query_datapoints(s, {"start_absolute": 0, "end_absolute": 9999, "metrics": [{"name": "m", "tags": {"host": ["a"]}}]}, 0)[0]
    return out.select("key", F.col("value").cast("decimal(2,1)").alias("v"))


@query("select event_id as key, value from events where value is not null")
def rest_none(spark, sf_dir):
    return R.query_datapoints(open_session(spark, sf_dir), {"start_absolute": 0, "end_absolute": END // 10**6, "metrics": [{"name": "events.value"}]}, 0)[0]


@query("select event_id as key, 'note ' || (event_id % 3) as note from events where event_id % 3 < 2 and event_id >= 20")
def rest_annotations(spark, sf_dir):
    """Annotations of two metrics, found by their categories, joined to the metrics' points."""
    s = Session(spark, by_key=False)
    for k in range(3):
        s.register(table(spark, sf_dir, "events").where(F.col("event_id") % 3 == k).select("event_id", "value"), f"m{k}", "event_id")
    R.ingest_datapoints(s, [{"name": f"m{k}.value", "annotation": {"title": f"note {k}", "category": ["kept" if k < 2 else "other"]}} for k in range(3)])
    found = R.query_annotations(s, {"metrics": [{"annotation": {"category": ["kept"]}}]})
    parts = [s.catalog.scan([a["metric"]]).where("key >= 20").select("key", F.lit(a["title"]).alias("note")) for a in found]
    return parts[0].unionAll(parts[1])


@query("select event_id as key, value, user_id from events where event_id % 2 = 0")
def ingest_messages(spark, sf_dir):
    """Points as JSON messages; a message whose type differs from its series' first one is dropped."""
    ev = table(spark, sf_dir, "events").where("event_id % 2 = 0")
    point = lambda path, kind, c: F.struct(F.lit(path).alias("path"), F.col("event_id").alias("timestamp"), F.lit(kind).alias("dataType"), F.col(c).cast("string").alias("value"))
    lines = ev.select(F.to_json(F.array(point("p.v", "double", "value"), point("p.u", "long", "user_id"))).alias("value"))
    wrong = ev.select(F.to_json(F.array(F.struct(F.lit("p.u").alias("path"), (F.col("event_id") + 10**9).alias("timestamp"), F.lit("boolean").alias("dataType"), F.lit("true").alias("value")))).alias("value"))
    s = Session(spark, by_key=False)
    register_points(s.catalog, read_messages(lines.unionAll(wrong)), {"p.v": "DOUBLE", "p.u": "LONG"})
    return s.execute("SELECT v, u FROM p").toDF("key", "value", "user_id")


__all__ = ["QUERIES", "SQL"]
