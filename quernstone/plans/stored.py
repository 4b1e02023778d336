"""Search indexes of the queries' tables: built once a session and state of the table, in a shared folder, and read by every search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators.index import SearchIndex
from quernstone.operators.store import Store, shared_folder

_ROOTS: dict[tuple, str] = {}


def state(spark: SparkSession, path: str) -> tuple:
    """What tells a table's files: how many, their bytes, the latest time of change, and a hash of names, sizes and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    n = size = last = sign = 0
    while files.hasNext():
        f = files.next()
        n, size, last = n + 1, size + f.getLen(), max(last, f.getModificationTime())
        sign ^= hash((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return n, size, last, sign


def index(spark: SparkSession, path: str, name: str, items: Callable[[], DataFrame], columns: list[str]) -> SearchIndex:
    """The index of a table's items; the first query that asks after the table's files changed writes it anew."""
    key = spark.sparkContext.applicationId, path, name, state(spark, path)
    found = SearchIndex(Store(spark, _ROOTS.get(key) or shared_folder(spark, f"index-{name}")), columns, detail_is_json=False)
    if key not in _ROOTS:
        found.build(items())
        _ROOTS[key] = found.store.root
    return found
