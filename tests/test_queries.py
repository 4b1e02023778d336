"""Every registered query of the engine against its SQL, and without SQL for a stable result."""

import importlib.util

import duckdb
import pytest

from quernstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr([plain(x) for x in v]) if isinstance(v, list) else repr(v)


def rows(arrow):
    columns = sorted(arrow.column_names)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in arrow.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(name, spark, sf, duck):
    assert rows(registry.QUERIES[name](spark, sf).toArrow()) == rows(duck.execute(registry.ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_alike_twice(name, spark, sf):
    first = rows(registry.QUERIES[name](spark, sf).toArrow())
    assert first[1] and first == rows(registry.QUERIES[name](spark, sf).toArrow())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("quernstone.llm") is None:
        assert not any(n.startswith("op") for n in entry.queries())
