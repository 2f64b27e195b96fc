"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows."""

import importlib.util
import math
import sys

import duckdb
import pytest

sys.path.insert(0, "/".join(__file__.split("/")[:-2]))
from flowlab import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "null" if math.isnan(v) else f"{float(v):.5f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(set(SQL) & set(QUERIES)))
def test_against_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    names, have = rows(got.columns, [tuple(r) for r in got.collect()])
    wanted_names, wanted = rows(columns, want.fetchall())
    assert names == wanted_names
    assert have == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_has_all_queries():
    assert importlib.util.find_spec("__spark_entry__") is not None
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
