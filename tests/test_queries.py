"""Every query against its SQL, as row multisets; queries without SQL give rows of a stable schema."""

import os

import duckdb
import pytest

from fathom import queries

SF = os.environ.get("FATHOM_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(float(a) - float(b)) <= 2e-6 * max(1, abs(float(a)))
    return a == b


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0, str(x) if not isinstance(x, (int, float)) else "") for x in r)
    a, b = sorted(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect()), key=key), sorted(want, key=key)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if not all(map(close, x, y))][:3] == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
