"""The series engine on small fixtures with known results."""

import pytest

from lodestrand.functions.timeutil import date_ns, duration_ns
from lodestrand.operators import rest
from lodestrand.operators.curve import curve_match
from lodestrand.plans.errors import StatementError
from lodestrand.plans.parser import Select, parse
from lodestrand.plans.planner import key_ranges
from lodestrand.session import Session


@pytest.fixture()
def session(spark):
    s = Session(spark)
    df = spark.range(15000).selectExpr("id key", "id s1", "id + 1 s2", "concat('t', id) s3", "id + 0.1D s4")
    return s.register(df, "us.d1")


def got(df):
    return [tuple(r) for r in df.collect()]


def test_ranges_and_aggregates(session):
    assert got(session.execute("SELECT s1 FROM us.d1 WHERE s1 > 4 AND s1 < 8;")) == [(5, 5), (6, 6), (7, 7)]
    df = session.execute("SELECT max(s1), count(s4), sum(s2), first_value(s3) FROM us.d1 WHERE key > 0 AND key < 1000")
    assert df.columns == ["max(us.d1.s1)", "count(us.d1.s4)", "sum(us.d1.s2)", "first_value(us.d1.s3)"] and got(df) == [(999, 999, 500499, "t1")]
    assert got(session.execute("COUNT POINTS")) == [(60000,)]


def test_windows(session):
    assert got(session.execute("SELECT max(s1) FROM us.d1 GROUP (0, 1000) BY 100ns"))[:2] == [(1, 100), (101, 200)]
    hop = got(session.execute("SELECT sum(s1) FROM us.d1 GROUP (0, 1000) BY 100ns SLIDE 50ns"))
    assert len(hop) == 19 and hop[0] == (1, 5050) and hop[-1][0] == 901
    same = got(session.execute("SELECT sum(s1) FROM us.d1 GROUP [0, 1000) BY 100ns SLIDE 100ns"))
    assert same == got(session.execute("SELECT sum(s1) FROM us.d1 GROUP [0, 1000) BY 100ns"))
    nested = session.execute("SELECT max_s1 FROM (SELECT max(s1) AS max_s1 FROM us.d1 GROUP [1000, 1600) BY 60ns)")
    assert nested.columns == ["key", "max_s1"] and got(nested)[0] == (1000, 1059) and nested.count() == 10


@pytest.mark.parametrize(
    ("text", "message"),
    [
        # the messages are fixed values
        ("SELECT s4 FROM us.d1 GROUP [7, 70) BY 9ns", "Group by clause cannot be used without aggregate function."),
        ("SELECT count(s3), first(s4) FROM us.d1 WHERE key < 12", "SetToSet/SetToRow/RowToRow functions can not be mixed in aggregate query."),
        ("SELECT cos(s4), avg(s4) FROM us.d1", "SetToSet/SetToRow/RowToRow functions can not be mixed in aggregate query."),
        ("SELECT s2, sum(s4) FROM us.d1", "SetToSet/SetToRow functions and non-function modified path can not be mixed."),
        ("SELECT avg(s4) FROM us.d1 GROUP [44, 44) BY 2ns", "Start time should be smaller than endTime in time interval."),
        ("SELECT sum(s4) FROM us.d1 ORDER BY KEY DESC", "Not support ORDER BY clause in aggregate query."),
        ("DELETE FROM us.d1.s4 WHERE key < 3 AND key > 8", "This clause delete nothing, check your filter again."),
        ("DELETE FROM us.d1.s3, us.d1.s4 WHERE s3 = 't9' OR key = 1", "delete clause can not use value or path filter."),
        ("DELETE FROM us.d1.s4 WHERE key <> 77 OR key < 5", "Not support [!=] in delete clause."),
    ],
)
def test_errors(session, text, message):
    with pytest.raises(StatementError) as e:
        session.execute(text)
    assert message in str(e.value)


@pytest.fixture()
def sides(spark):
    s = Session(spark)
    s.execute("INSERT INTO test(key, a.a, a.b) VALUES (1, 1, 1.1), (2, 3, 3.1), (3, 5, 5.1), (4, 7, 7.1), (5, 9, 9.1)")
    s.execute("INSERT INTO test(key, b.a, b.b) VALUES (1, 2, 2.1), (2, 3, 3.1), (3, 4, 4.1), (4, 5, 5.1), (5, 6, 6.1)")
    return s


def test_joins(sides):
    inner = sides.execute("SELECT * FROM test.a INNER JOIN test.b ON test.a.a = test.b.a")
    assert inner.columns == ["test.a.a", "test.a.b", "test.a.key", "test.b.a", "test.b.b", "test.b.key"]
    assert sorted(got(inner)) == [(3, 3.1, 2, 3, 3.1, 2), (5, 5.1, 3, 5, 5.1, 4)]
    assert sides.execute("SELECT * FROM test.a LEFT JOIN test.b USING a").columns == ["test.a.a", "test.a.b", "test.a.key", "test.b.b", "test.b.key"]
    for how, n in (("LEFT", 5), ("RIGHT", 5), ("FULL", 8)):
        assert sides.execute(f"SELECT * FROM test.a {how} JOIN test.b ON test.a.a = test.b.a").count() == n
    assert sides.execute("SELECT * FROM test.a CROSS JOIN test.b").count() == 25
    assert sides.execute("SELECT * FROM test.a NATURAL JOIN test.b").count() == 2
    assert sides.execute("SELECT * FROM test.a, test.b WHERE test.a.a = test.b.a").count() == 2


def test_arithmetic(spark):
    s = Session(spark)
    s.execute("INSERT INTO us.d3(key, s1, s2, s3) VALUES (1, 1, 6, 1.5), (2, 2, 5, 2.5), (3, 3, NULL, 3.5)")
    df = s.execute("SELECT s1+1, s2-1, s3*2 FROM us.d3;")
    assert df.columns == ["key", "us.d3.s1 + 1", "us.d3.s2 - 1", "us.d3.s3 × 2"] and got(df)[0] == (1, 2, 5, 3.0) and got(df)[2][2] is None
    assert got(s.execute("SELECT s1/s2, s1%s2, s1/0.0 FROM us.d3 WHERE key = 1")) == [(1, 0, 1, float("inf"))]
    with pytest.raises(StatementError):
        s.execute("SELECT s1 + * FROM us.d3")


def test_tags(spark):
    s = Session(spark)
    s.execute("INSERT INTO ah.hr01(key, s, v) VALUES (0, 1, 2), (1, 2, 3)")
    s.execute("INSERT INTO ah.hr01[t1=v1,t2=vv1](key, s) VALUES (0, 3), (9, 4)")
    s.execute("INSERT INTO ah.hr02(key, s[t1=v1]) VALUES (400, false)")
    assert s.execute("SELECT s FROM ah.*").columns == ["key", "ah.hr01.s", "ah.hr01.s{t1=v1,t2=vv1}", "ah.hr02.s{t1=v1}"]
    assert s.execute("SELECT s FROM ah.* WITHOUT TAG").columns == ["key", "ah.hr01.s"]
    assert s.execute("SELECT s FROM ah.* WITH t1=v1 AND t2=*").columns == ["key", "ah.hr01.s{t1=v1,t2=vv1}"]
    assert s.execute("SELECT s FROM ah.* WITH_PRECISE t1=v1").columns == ["key", "ah.hr02.s{t1=v1}"]
    assert s.execute("SELECT s AS ts FROM ah.hr01").columns == ["key", "ts", "ts{t1=v1,t2=vv1}"]
    assert got(s.execute("SELECT s FROM ah.hr01 WHERE key < 5")) == [(0, 1, 3), (1, 2, None)]
    assert got(s.execute("SELECT last(s) FROM ah.hr01")) == [(1, "ah.hr01.s", "2"), (9, "ah.hr01.s{t1=v1,t2=vv1}", "4")]
    assert got(s.execute("SHOW TIME SERIES ah.hr01.* LIMIT 1 OFFSET 1")) == [("ah.hr01.s{t1=v1,t2=vv1}", "LONG")]


def test_insert_delete(spark):
    s = Session(spark)
    s.execute("INSERT INTO a(key, x, y) VALUES (1, 1, 'p'), (2, 2, NULL), (2, NULL, 'q')")
    s.execute("INSERT INTO a(key, x) VALUES (2, 20), (3, NaN)")
    assert got(s.execute("SELECT * FROM a")) == [(1, 1, "p"), (2, 20, "q")]
    s.execute("INSERT INTO b(key, z) VALUES (SELECT x FROM a) TIME_OFFSET = 100")
    assert got(s.execute("SELECT z FROM b")) == [(101, 1), (102, 20)]
    s.execute("DELETE FROM a.x WHERE key >= 2")
    assert got(s.execute("SELECT x FROM a")) == [(1, 1)]
    s.execute("DELETE TIME SERIES a.y")
    assert s.execute("SELECT * FROM a").columns == ["key", "a.x"]
    s.execute("CLEAR DATA")
    assert s.execute("SHOW TIME SERIES").count() == 0 and s.execute("SELECT * FROM a").count() == 0
    with pytest.raises(StatementError):
        s.execute("INSERT INTO a(key, x) VALUES (1, 2, 3)")


def test_special_paths_dates_and_patterns(spark):
    s = Session(spark)
    s.execute("INSERT INTO 测试.前缀(key, 后缀, 1919810, _:@#$) VALUES (2021-08-26 16:15:27, 1, 2, 3), (2021/08/26T16:15:28.001, 4, 5, 6)")
    assert got(s.execute("SELECT 1919810, _:@#$ FROM 测试.前缀")) == [(date_ns("2021-08-26 16:15:27"), 2, 3), (date_ns("2021.08.26 16:15:28.001"), 5, 6)]
    assert s.execute("SELECT 后缀 FROM 测试.前缀 WHERE key > 2021-08-26 16:15:27 + 500ms").count() == 1
    assert duration_ns("1d2h3ms") == 93_600_003_000_000 and duration_ns("1mo", 0) == 31 * 86_400_000_000_000
    q = parse("select a.*.b as c from x limit 3, 4")
    assert isinstance(q, Select) and (q.offset, q.limit, q.items[0].path) == (3, 4, "a.*.b")
    assert key_ranges(("not", ("and", [("key", ">", 3), ("key", "<=", 9)]))) == [(-(2**63), 3), (10, 2**63 - 1)]


def test_structured_calls_and_precision(spark, session):
    s = Session(spark)
    for p, k in (("s", 100), ("ms", 100_000), ("us", 100_000_000), ("ns", 100_000_000_000)):
        s.insert_row_records([f"p.{p}"], [k], [[1]], precision=p)
    assert got(s.query(["p.*"], 99, 101, precision="s")) == [(100_000_000_000, 1, 1, 1, 1)]
    assert got(session.aggregate_query(["us.d1.s1"], 0, 10, "sum")) == [(45,)]
    assert got(session.downsample_query(["us.d1.s1"], 0, 20, "max", 10)) == [(0, 9), (10, 19)]
    assert got(session.last_query(["us.d1.s1"], 5)) == [(14999, "us.d1.s1", "14999")]


def test_functions_and_jobs(session, tmp_path):
    # local classes travel to the workers by value
    class AddOne:
        def transform(self, rows):
            return [rows[0]] + [[r[0], r[1] + 1] for r in rows[1:]]

    class Total:
        def transform(self, rows):
            return [["sum"], [sum(r[1] for r in rows[1:])]]

    assert session.execute("SELECT cos(s1) FROM us.d1 WHERE s1 < 3").columns == ["key", "cos(us.d1.s1)"]
    assert got(session.execute("SELECT udf_max(s1) FROM us.d1 WHERE s1 < 30")) == [(29,)]
    (tmp_path / "f.py").write_text("class Rev:\n    def transform(self, rows):\n        return [list(r) for r in rows[::-1]]\n")
    session.execute(f'REGISTER UDSF PYTHON TASK "Rev" IN "{tmp_path}/f.py" AS "rev"')
    assert got(session.execute("SELECT rev(s1) FROM us.d1 WHERE s1 < 3")) == [(2,), (1,), (0,)]
    assert "rev" in [r[0] for r in got(session.execute("SHOW REGISTER PYTHON TASK"))]
    session.execute('DROP PYTHON TASK "rev"')
    from lodestrand.functions.udf import Registered

    session.functions.by_name |= {"add_one": Registered("transform", "add_one", AddOne), "total": Registered("transform", "total", Total)}
    tasks = [{"kind": "sql", "sql": ["SELECT s1 FROM us.d1 WHERE s1 < 200"]}, {"kind": "python", "name": "add_one", "flow": "stream"}, {"kind": "python", "name": "total", "flow": "batch"}]
    assert got(session.jobs.build(tasks)) == [(20100,)]
    job = session.jobs.commit(tasks, "file", str(tmp_path / "out"))
    assert session.jobs.wait(job, 120) == "finished" and job in session.jobs.in_state("finished")
    assert got(session.execute(f"SHOW TRANSFORM JOB STATUS {job}")) == [(job, "finished")]
    with pytest.raises(StatementError):
        session.jobs.commit(tasks[1:])


def test_metrics(spark):
    s = Session(spark)
    rest.ingest_datapoints(s, [{"name": "m", "tags": {"host": "a"}, "datapoints": [[1000, 1.0], [2000, 2.0], [3000, 4.0], [4000, 8.0]]}, {"name": "n", "timestamp": 5, "value": 7}])
    ask = lambda **agg: [(r["key"] // 10**6, r["value"]) for r in rest.query_datapoints(s, {"start_absolute": 0, "end_absolute": 9999, "metrics": [{"name": "m", "tags": {"host": ["a"]}, "aggregators": [agg]}]}, 0)[0].orderBy("key").collect()]
    assert ask(name="percentile", percentile=0.9, sampling={"value": 10, "unit": "seconds"}) == [(0, 4.0)]
    assert ask(name="diff") == [(2000, 1.0), (3000, 2.0), (4000, 4.0)]
    assert ask(name="rate", unit="seconds") == [(2000, 1.0), (3000, 2.0), (4000, 4.0)]
    assert ask(name="filter", filter_op="gte", threshold=4) == [(3000, 4.0), (4000, 8.0)]
    assert ask(name="sum", sampling={"value": 2, "unit": "seconds"}) == [(0, 1.0), (2000, 6.0), (4000, 8.0)]
    assert ask(name="dev", sampling={"value": 10, "unit": "seconds"})[0][1] == pytest.approx(7.1875)
    notes = rest.Annotations()
    notes.add("m", {}, ["x", "y"], "t")
    notes.update("m", ["x"], ["z"])
    assert notes.find("m", ["z"]) and not notes.find("m", ["x"])


def test_curve_match(spark):
    values = [0.0] * 40 + [1, 5, 9, 5, 1] + [0.0] * 40
    df = spark.createDataFrame([(i * 10, float(v) * 3 + 2, None) for i, v in enumerate(values)], "key bigint, a double, b double")
    assert got(curve_match(df, ["a", "b"], [1, 5, 9, 5, 1], 10, 0, 10**6))[0][:2] == ("a", 400)
    assert curve_match(df.limit(0), ["a"], [1, 2], 10, 0, 10**6).count() == 0


def test_csv_and_stream(spark, session, tmp_path):
    from lodestrand.sources import open_source
    from lodestrand.streaming import ingest_stream, ingested_series, read_messages

    df = session.execute("SELECT s1, s4 FROM us.d1 WHERE s1 < 5")
    session.write(df.toDF("key", "s1", "s4"), str(tmp_path / "csv"), "csv")
    assert open_source(spark, "csv", path=str(tmp_path / "csv")).count() == 5
    with pytest.raises(StatementError):
        open_source(spark, "nothing")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('[{"path":"p.a","timestamp":1,"dataType":"long","value":"5"},{"path":"p.b","timestamp":1,"dataType":"long","value":"6"}]\nbroken\n')
    stream = read_messages(spark.readStream.text(str(tmp_path / "in")))
    ingest_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert got(ingested_series(spark, str(tmp_path / "t"), ["p.a", "p.b"], "LONG")) == [(1, 5, 6)]
