"""Registered queries over a whole table of the tests, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, digits=4):
    """The rows of a query and of its SQL, in the SQL's order of columns, sorted."""
    plain = lambda rows: sorted((tuple(round(float(x), digits) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
        asked = db.execute(entry.oracle_sql()[name])
        columns, want = [c[0] for c in asked.description], asked.fetchall()
    return plain(entry.queries()[name](spark, folder).select(*columns).collect()), plain(want)


@pytest.fixture(scope="module")
def longer(spark, data, tmp_path_factory):
    """The events of the test data at 20 times their number, so that none of the fixed ranges holds them all."""
    folder = tmp_path_factory.mktemp("longer")
    ev = spark.read.parquet(f"{data}/events.parquet")
    n = ev.count()
    ev.crossJoin(spark.range(20).withColumnRenamed("id", "_copy")).selectExpr(f"event_id + _copy * {n} as event_id", "ts", "user_id + _copy as user_id", "event_type", "value + _copy as value", "props").write.parquet(f"{folder}/events.parquet")
    (folder / "events.parquet" / "_SUCCESS").unlink()
    return str(folder)


WINDOWS = [*(f"downsample_tumbling_{f}" for f in ("count", "sum", "avg", "max", "min", "first_value", "last_value")), "downsample_hopping", "downsample_hopping_gaps", "downsample_filtered", "downsample_bounds", "downsample_level", "arith_over_downsample", "subquery_nested_agg", "udaf_avg"]


@pytest.mark.parametrize("name", WINDOWS)
def test_windows_over_whole_tables(spark, longer, name):
    got, want = both(spark, longer, f"{name}_whole")
    assert got == want and got


def test_windows_reach_the_last_event(spark, longer):
    got, _ = both(spark, longer, "downsample_tumbling_count_whole")
    assert sum(r[1] for r in got) == spark.read.parquet(f"{longer}/events.parquet").count() == 20_000


@pytest.mark.parametrize("name", ["join_using", "join_natural", "join_natural_left", "join_natural_right", "arith_double_zero"])
def test_joins_and_zero_divisors_over_whole_tables(spark, longer, name):
    got, want = both(spark, longer, f"{name}_whole")
    assert repr(got) == repr(want) and got  # NaN is not equal to itself
    if name == "arith_double_zero":
        assert len(got) == 20_000


def test_sides_overlap_in_part(spark, longer):
    left, right, inner = ({r[0] for r in both(spark, longer, f"join_natural{how}_whole")[0]} for how in ("_left", "_right", ""))
    assert inner == left & right and inner and left - right and right - left


@pytest.mark.parametrize("name", ["rest_sum", "rest_avg", "rest_save_as", "udsf_running", "transform_batch"])
def test_operators_over_whole_tables(spark, longer, name):
    got, want = both(spark, longer, name)
    assert got == want and len(got) == {"rest_sum": 40, "rest_avg": 40, "transform_batch": 1}.get(name, 20_000)
