"""All queries of the knowledge-base engine, by name, with their DuckDB equivalents."""

from quernstone.plans.carriers import table  # noqa: F401

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows, if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register
