"""Every registered query of the engine on the smallest tables, against its SQL; and the entry without the text subpackage."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrand.api_queries import QUERIES, SQL


#: No row of the smallest tables fits.
EMPTY_HERE = ("filter_not", "filter_or_key_value", "filter_path_pair", "subquery_filter")


def plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else round(x, 4) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db(data):
    with duckdb.connect() as c:
        c.execute("set timezone = 'UTC'")
        for f in os.listdir(data):
            c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
        yield c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, data, db, name):
    asked = db.execute(SQL[name])
    columns, want = [c[0] for c in asked.description], asked.fetchall()
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    assert repr(plain(got)) == repr(plain(want)) and (got or name in EMPTY_HERE)


def test_percentiles_against_exact_ranks(spark, data, db):
    from lodestrand import problems as P

    exact = db.execute(P._P2_CTE + "select data_center, day_no, list_sort(list(val)) l from kept group by grouping sets ((data_center, day_no), (data_center))").fetchall()
    values = {(dc, day): held for dc, day, held in exact}
    seen = 0
    for r in P.p2_percentiles(spark, data).collect():
        held = values[r["data_center"], r["day_no"]]
        low, high = sum(v < r["estimate"] for v in held) / len(held), sum(v <= r["estimate"] for v in held) / len(held)
        error = max(0.0, low - r["prob"], r["prob"] - high)
        assert r["n"] == len(held) and math.isclose(error, r["error"], abs_tol=1e-12) and error * len(held) <= max(1.0, 0.005 * len(held))
        seen += 1
    assert seen == len(values) * len(P.P2_PROBS)


def test_entry_in_a_copy_without_the_text_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "lodestrand", tmp_path / "lodestrand", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[:2] in ('p7', 'p8', 'p9') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(sum(n[:2] not in ("p7", "p8", "p9") for n in entry.queries())), "False", "True"]


def test_entry_without_a_library_of_the_text_subpackage(tmp_path):
    (tmp_path / "regex.py").write_text("raise ImportError('not here')")
    ask = "import __spark_entry__ as e; q = e.queries(); print('p1_found' in q, 'p7_ids' in q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", ask], cwd=Path(entry.__file__).parent, env=env, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[0] == "True"
