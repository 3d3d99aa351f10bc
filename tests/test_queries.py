"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from rcspark import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(type(x)), x) for x in r])
    got = order([tuple(r[c] for c in columns) for r in df.collect()])
    at = [want.columns.index(c) for c in columns]
    rows = order([tuple(r[i] for i in at) for r in want.fetchall()] if hasattr(want, "fetchall") else [])
    assert len(got) == len(rows)
    assert all(close(x, y) for a, b in zip(got, rows) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_others_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "reservoir_user_nmae" in entry.queries()


def test_parametric_fit_trains_on_whole_segments(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(series, cfg):
        raise Seen(series.count())

    monkeypatch.setattr(queries.plans, "fit", fit)
    with pytest.raises(Seen) as seen:
        queries.QUERIES["parametric_fit"](spark, SF_DIR)
    assert seen.value.args == (queries.src.region_orders(spark, SF_DIR).count(),)
