"""Transformers, numbering, several sources and user functions on small fixtures: nulls, ties and empty inputs."""

import pytest

from lodestrand.functions import transformers as N
from lodestrand.functions.udf import Registered
from lodestrand.operators.common import numbered
from lodestrand.plans.errors import StatementError
from lodestrand.plans.parser import split_statements
from lodestrand.session import Session


def got(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture()
def rows(spark):
    nan = float("nan")
    return spark.createDataFrame([(1, 2.0, "a"), (2, nan, "b"), (3, 9.0, "a"), (4, None, None), (5, 9.0, "a"), (6, 1.0, "b"), (7, 1.0, "b")], "key bigint, `m.x` double, `m.s` string").repartitionByRange(3, "key").sortWithinPartitions("key")


def test_transformers(rows):
    assert [r[0] for r in sorted(got(N.distinct(rows)))] == [1, 2, 3, 4, 6]
    assert got(N.head(rows, 2)) == [(1, 2.0, "a")] + got(rows)[1:2] or len(got(N.head(rows, 2))) == 2
    assert [r[0] for r in got(N.bottom(rows, 3))] == [5, 6, 7] and [r[0] for r in got(N.sort_index(rows))] == [7, 6, 5, 4, 3, 2, 1]
    assert got(N.spread(rows)) == [(6, 2 - 5)]  # the first 9.0 stands at place 2, the first 1.0 at 5
    assert got(N.mean(rows)) == [(4.0, 22 / 5)]
    assert N.keep_columns(["m.s", "none"])(rows).columns == ["m.s"] and got(N.row_at(1)(rows))[0][0] == 2
    assert got(N.between_time(3, 5)(rows))[0][0] == 3 and [r[0] for r in got(N.between_time(6, 1)(rows))] == [1, 6, 7]


def test_transformers_of_nothing(rows):
    empty = rows.limit(0)
    assert got(N.distinct(empty)) == got(N.head(empty)) == got(N.bottom(empty)) == got(N.row_at(0)(empty)) == []
    assert got(N.mean(empty)) == got(N.skew(empty)) == got(N.spread(empty)) == [(None, None)]


def test_numbering_keeps_the_order(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("999 - id as v").orderBy("v")
    assert sorted(got(numbered(df, "at", 5))) == [(v, v + 5) for v in range(1000)] and numbered(df.limit(0), "at").count() == 0


def test_sources_are_aggregated_one_by_one(spark):
    s = Session(spark)
    s.register(spark.createDataFrame([(1, 1, None), (2, 3, 4.0)], "key bigint, n int, x double"), "a").register(spark.createDataFrame([(2, 10)], "key bigint, n int"), "b.c")
    df = s.execute("SELECT sum(*), count(*) FROM * GROUP BY LEVEL = 0")
    assert dict(zip(df.columns, got(df)[0], strict=True)) == {"sum(a.*)": 8.0, "sum(b.*.*)": 10, "count(a.*)": 3, "count(b.*.*)": 1}
    assert "Join" not in s.execute("SELECT count(*) FROM *")._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
    s.register(spark.createDataFrame([(1, 100)], "key bigint, n int"), "a")  # a.n is in two sources now: the later value of a key holds
    assert got(s.execute("SELECT sum(n) FROM a")) == [(103,)]


def test_repeated_keys_stay_rows(spark):
    class Twice:
        def transform(self, row):
            return [None if v is None else v * 2 for v in row]

    s = Session(spark).register(spark.createDataFrame([(1, 1.0), (1, 2.0), (2, None)], "key bigint, v double"), "r")
    s.functions.by_name["twice"] = Registered("udtf", "twice", Twice, returns="double")
    assert sorted(got(s.execute("SELECT twice(v), v, cos(v) AS c FROM r").select("`twice(r.v)`", "`r.v`")), key=repr) == [(2.0, 1.0), (4.0, 2.0)]


def test_declared_types_need_no_job(spark, tmp_path):
    (tmp_path / "g.py").write_text("class Len:\n    returns = 'bigint'\n    def transform(self, row):\n        return [None if v is None else len(v) for v in row]\n")
    s = Session(spark).register(spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "key bigint, v string"), "t")
    s.execute(f'REGISTER UDTF PYTHON TASK "Len" IN "{tmp_path}/g.py" AS "len"')
    df = s.execute("SELECT len(v) FROM t")
    assert dict(df.dtypes)["len(t.v)"] == "bigint" and got(df) == [(1, 3), (3, 0)]
    with pytest.raises(StatementError):
        s.execute("SELECT len(v) + 1 FROM t")


def test_statements_are_parted_outside_quotes():
    assert split_statements("A 'x;y'; B \"p;q\" ;") == ["A 'x;y'", " B \"p;q\" "] and split_statements("A") == ["A"]
    assert split_statements("DELETE FROM a.x 'p; B") == ["DELETE FROM a.x 'p", " B"]


def test_no_statement_runs_if_one_cannot_be_read(spark):
    s = Session(spark)
    with pytest.raises(StatementError):
        s.execute("INSERT INTO a(key, x) VALUES (1, 1); DELETE FROM 'a")
    assert s.catalog.types == {}


def test_jobs_fail_and_are_cancelled(spark):
    s = Session(spark).register(spark.range(10).selectExpr("id key", "id v"), "j")
    with pytest.raises(StatementError):
        s.jobs.commit([{"kind": "sql", "sql": ["CLEAR DATA"]}])
    number = s.jobs.commit([{"kind": "sql", "sql": ["SELECT v FROM j"]}, {"kind": "python", "name": "none"}])
    assert s.jobs.wait(number, 60) == "failed" and got(s.execute("SHOW FAILED TRANSFORM JOB")) == [(number,)]
    s.execute(f"CANCEL TRANSFORM JOB {number}")
    assert s.jobs.status(number) == "failed" and s.jobs.status(99) == "unknown"


def test_many_inserts_become_one_source(spark):
    s = Session(spark)
    for k in range(6):
        s.execute(f"INSERT INTO a(key, x) VALUES ({k % 4}, {k})")
    before = got(s.execute("SELECT x FROM a"))
    s.catalog.compact()
    assert len(s.catalog.sources) == 1 and got(s.execute("SELECT x FROM a")) == before == [(0, 4), (1, 5), (2, 2), (3, 3)]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from lodestrand.operators.common import ensure_checkpoint_dir

    class Plain:
        def __init__(self, **held):
            self.__dict__ |= held

    def session(master, folder, taken):
        none = Plain(isEmpty=lambda: True)
        context = Plain(master=master, _jsc=Plain(sc=lambda: Plain(getCheckpointDir=lambda: none)), setCheckpointDir=taken.append)
        return Plain(sparkContext=context, conf=Plain(get=lambda key, default: folder))

    taken = []
    ensure_checkpoint_dir(session("spark://somewhere:7077", "hdfs://shared/x", taken))
    ensure_checkpoint_dir(session("local[8]", None, taken))
    assert taken[0] == "hdfs://shared/x" and len(taken) == 2
    for master in ("spark://somewhere:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master, None, taken))
