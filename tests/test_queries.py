"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from driftlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    return v


def _rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_name_is_defined_twice():
    import ast
    from pathlib import Path

    for f in Path(catalog.__file__).parent.rglob("*.py"):
        for scope in ast.walk(ast.parse(f.read_text())):
            if isinstance(scope, (ast.Module, ast.ClassDef)):
                names = [x.name for x in scope.body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
                assert len(names) == len(set(names)), f


def test_no_query_is_registered_twice():
    name = next(iter(catalog.queries()))
    f = lambda spark, d: None
    f.__name__ = name
    with pytest.raises(ValueError, match=name):
        catalog.query()(f)
