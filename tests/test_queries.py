"""Every query of the file-tree engine with SQL against DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from treediff.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, list) else v


def same(rows, columns, wanted, names):
    at = lambda cols: sorted(range(len(cols)), key=lambda k: cols[k])
    key = lambda rs, cols: sorted(str([plain(r[k]) for k in at(cols)]) for r in rs)
    assert sorted(columns) == sorted(names)
    assert key(rows, columns) == key(wanted, names)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    same([tuple(r) for r in df.collect()], df.columns, found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
