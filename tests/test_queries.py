"""Every core query against its SQL on the smallest tables."""

import numbers
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from folioloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict(recursive=True)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (numbers.Real, Decimal)):
        x = round(float(x), 9)
        return None if x != x else int(x) if x == int(x) else x
    return str(x)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, tables):
    frame = QUERIES[name](spark, tables)
    columns = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    assert len(set(frame.columns)) == len(frame.columns)
    if name in SQL:
        result = duck.sql(SQL[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
