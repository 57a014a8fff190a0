"""Zone names in texts, whatever their letters."""

from datetime import datetime
from zoneinfo import ZoneInfo, available_timezones

import pytest

from lodestrand.operators import timestamps as T


@pytest.mark.parametrize("form", ["2024-07-01 12:00:00 {}", "2024-07-01T12:00:00 [{}]"])
def test_every_zone_name_is_read(spark, form):
    java = set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    names = sorted(n for n in java & available_timezones() if "/" in n)
    assert {"Africa/Dar_es_Salaam", "America/Port_of_Spain", "Europe/Isle_of_Man", "Etc/UTC", "Etc/GMT+5", "Europe/Berlin"} <= set(names)
    df = spark.createDataFrame([(n, form.format(n), "Asia/Tokyo", "ymd") for n in names], "n string, t string, z string, o string")
    got = {r["n"]: r["rec_key"] for r in T.parse_instants(df, "t", "z", "o").collect()}
    want = {n: int(datetime(2024, 7, 1, 12, tzinfo=ZoneInfo(n)).timestamp()) * 10**9 for n in names}
    assert {n: got[n] for n in names if got[n] != want[n]} == {}


@pytest.mark.parametrize("text", ["2024-01-01 00:00:00 [Foo/Bar9]", "2024-01-01 00:00:00 Etc/GMT+99"])
def test_unknown_names_are_no_zone(spark, text):
    df = spark.createDataFrame([(text, "UTC", "ymd")], "t string, z string, o string")
    assert T.parse_instants(df, "t", "z", "o").collect()[0]["rec_key"] is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2250-01-01T00:00:00Z", 8835955200 * 10**9), ("1690-01-01T00:00:00Z", -8835868800 * 10**9), ("1677-09-20T00:00:00Z", None), ("2262-04-12T00:00:00Z", None), ("9999-12-31T23:59:59Z", None),
        ("2024-01-01T00:00:60Z", None), ("2024-01-01T24:00:00Z", None), ("2024-01-01T00:00:00-03:30", 1704079800 * 10**9), ("2024-01-01T00:00:00-0330", 1704079800 * 10**9), ("2024-01-01T00:00:00+19", None),
        ("ymd|2024|1|1|1|1|1||||", None), ("may|2024|1|1|1|1|1||||", None), ("1.5e9", None), ("1.7e9", 1700000000 * 10**9), ("1.700000000123e09", 1700000000123 * 10**6),
    ],
)
def test_texts_at_the_edges(spark, text, want):
    df = spark.createDataFrame([(text, "Europe/Berlin", "ymd")], "t string, z string, o string")
    assert T.parse_instants(df, "t", "z", "o").collect()[0]["rec_key"] == want


def test_years_of_bare_numbers_are_a_parameter(spark):
    df = spark.createDataFrame([("1000000000",), ("1000000000000",)], "t string").selectExpr("t", "'UTC' z", "'ymd' o")
    assert [r["rec_key"] for r in T.parse_instants(df, "t", "z", "o").collect()] == [None, None]
    assert [r["rec_key"] for r in T.parse_instants(df, "t", "z", "o", years=(2000, 2003)).collect()] == [10**18, 10**18]
