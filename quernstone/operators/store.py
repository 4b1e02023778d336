"""Versioned tables on Parquet: upserts, deletes with cascade, appends, exports, backups, logs.

A table is a folder of data folders ``d=<version>-<id>`` and of manifests ``_m/<version>.json``. A manifest names the data
folders that make up the state, so a mutation writes the rows it changes and leaves all others where they are: an append adds one
folder; a table with keys is hashed into buckets, and an upsert or delete rewrites the buckets that it touches. A manifest is
created, never replaced: of two writers that began at the same version one fails with ``Conflict``. Nothing is changed in
place, so a lost executor or driver leaves the last state, and versions stay readable until ``vacuum`` drops them.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKETS = 16  # of a table with keys
_FOLDER, _BUCKET = "d", "_bucket"


class Conflict(RuntimeError):
    """Another writer has written the version that this one was to write."""


class Store:
    """Tables under ``root``, any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/_m")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, name: str, version: int | None = None) -> dict | None:
        """The state of a version, of the last one whole by default: version, keys, partition, schema and folders."""
        for number in [version] if version is not None else reversed(self._numbers(name)):
            stream = self._fs.open(self._path(f"{self.root}/{name}/_m/{number}.json"))
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:  # its writer was lost
                continue
            finally:
                stream.close()
        return None

    def _commit(self, name: str, base: dict | None, state: dict) -> None:
        """The state as the version after ``base``."""
        taken = self._numbers(name)
        number = (base["version"] if base else 0) + 1
        if taken and taken[-1] >= number and self.manifest(name)["version"] >= number:
            raise Conflict(f"{name} is at version {taken[-1]}")
        number = max([number, *(n + 1 for n in taken)])
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}/_m/{number}.json"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"{name} has a version {number}") from e
            raise
        out.write(bytearray(json.dumps({**state, "version": number}).encode()))
        out.close()

    def versions(self, name: str) -> list[int]:
        return self._numbers(name)

    def exists(self, name: str) -> bool:
        return self.manifest(name) is not None

    # reading

    def _rows(self, name: str, state: dict, folders: list[dict], *, places: bool = False) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        whole = StructType(schema.fields).add(_FOLDER, StringType())
        if state["keys"]:
            whole = whole.add(_BUCKET, IntegerType())
        base = f"{self.root}/{name}"
        rows = self.spark.read.schema(whole).option("basePath", base).parquet(*(f"{base}/{f['path']}" for f in folders))
        return rows.select(*schema.fieldNames(), *([_FOLDER, *([_BUCKET] if state["keys"] else [])] if places else []))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        state = self.manifest(name, version)
        if state is None:
            raise FileNotFoundError(name)
        return self._rows(name, state, state["folders"])

    # writing

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _written(self, name: str, df: DataFrame, version: int, keys: list[str] | None, partition: list[str] | None) -> list[dict]:
        """Rows written as one data folder; with keys, the folders of its buckets."""
        folder = f"{_FOLDER}={version:06d}-{uuid.uuid4().hex[:8]}"
        by = [_BUCKET] if keys else partition or []
        if keys:
            df = df.withColumn(_BUCKET, self._bucket(keys)).repartition(_BUCKET)
        df.write.partitionBy(*by).parquet(f"{self.root}/{name}/{folder}")
        if not keys:
            return [{"path": folder}]
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}/{folder}"))]
        return [{"path": f"{folder}/{n}", "bucket": int(n.split("=")[1])} for n in sorted(made) if n.startswith(_BUCKET)]

    def write(self, name: str, df: DataFrame, *, keys: list[str] | None = None, partition: list[str] | None = None) -> DataFrame:
        """The rows as the whole table; with ``keys`` it is hashed into buckets, with ``partition`` parted by its columns."""
        base = self.manifest(name)
        folders = self._written(name, df, base["version"] + 1 if base else 1, keys, partition)
        self._commit(name, base, {"keys": keys, "partition": partition, "buckets": self.buckets, "schema": df.schema.jsonValue(), "folders": folders})
        return self.read(name)

    def append(self, name: str, df: DataFrame, *, partition: list[str] | None = None) -> DataFrame:
        """Further rows, in a folder of their own; the table takes on their new columns."""
        base = self.manifest(name)
        if base is None:
            return self.write(name, df, partition=partition)
        df = self._fitting(base, df)
        folders = self._written(name, df, base["version"] + 1, base["keys"], base["partition"])
        self._commit(name, base, {**base, "schema": self._joint(base, df).jsonValue(), "folders": base["folders"] + folders})
        return self.read(name)

    @staticmethod
    def _joint(base: dict, df: DataFrame) -> StructType:
        """The table's columns and the new ones of the rows, all of which may be null."""
        old = StructType.fromJson(base["schema"])
        return StructType(old.fields + [f for f in df.schema.fields if f.name not in old.fieldNames()])

    def _fitting(self, base: dict, df: DataFrame) -> DataFrame:
        """The rows with the types of the table's columns."""
        types = {f.name: f.dataType for f in StructType.fromJson(base["schema"]).fields}
        return df.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))

    def merge(self, name: str, df: DataFrame, keys: list[str], merged: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The buckets that the rows touch, replaced by ``merged(their rows, the new rows)``. The table is hashed by its keys
        the first time; until then, or under other keys, it is written whole."""
        base = self.manifest(name)
        if base is None:
            return self.write(name, merged(df.limit(0), df), keys=keys)
        df = self._fitting(base, df)
        if base["keys"] != keys or base["buckets"] != self.buckets:
            return self.write(name, merged(self._rows(name, base, base["folders"]), df), keys=keys)
        df = materialized(df, "touching")
        touched = {r[0] for r in df.select(self._bucket(keys)).distinct().collect()}  # numbers of buckets
        old = [f for f in base["folders"] if f["bucket"] in touched]
        rows = merged(self._rows(name, base, old), df)
        folders = self._written(name, rows, base["version"] + 1, keys, None)
        self._commit(name, base, {**base, "schema": self._joint(base, df).jsonValue(), "folders": [f for f in base["folders"] if f not in old] + folders})
        return self.read(name)

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """The rows in place of those with their keys; only the buckets of these keys are written."""
        return self.merge(name, df, keys, lambda old, new: upserted(old, new, keys))

    def delete(self, name: str, ids: DataFrame, key: str = "id", children: dict[str, str] | None = None) -> None:
        """Rows with these keys, and the rows of child tables that point at them. Folders without such rows stay."""
        ids = materialized(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), "ids")
        for table, column in {name: key, **(children or {})}.items():
            base = self.manifest(table)
            if base is None:
                continue
            hit = F.col(column) == F.col("_id")
            where = base["folders"]
            if base["keys"] == [column] and base["buckets"] == self.buckets:
                types = {f.name: f.dataType for f in StructType.fromJson(base["schema"]).fields}
                asked = ids.select(F.col("_id").cast(types[column]).alias(column))
                buckets = {r[0] for r in asked.select(self._bucket([column])).distinct().collect()}
                where = [f for f in where if f["bucket"] in buckets]
            if where:
                at = [_FOLDER, *([_BUCKET] if base["keys"] else [])]
                found = self._rows(table, base, where, places=True).join(ids, hit, "left_semi").select(*at).distinct().collect()  # folders
                names = {f"{_FOLDER}={r[0]}" + (f"/{_BUCKET}={r[1]}" if base["keys"] else "") for r in found}
                where = [f for f in where if f["path"] in names]
            folders = [f for f in base["folders"] if f not in where]
            if where:
                rest = self._rows(table, base, where).join(ids, hit, "left_anti")
                folders = folders + self._written(table, rest, base["version"] + 1, base["keys"], base["partition"])
            self._commit(table, base, {**base, "folders": folders})

    def clear(self, names: list[str]) -> None:
        for name in names:
            if base := self.manifest(name):
                self._commit(name, base, {**base, "folders": []})

    def vacuum(self, name: str, keep: int = 1) -> list[str]:
        """Drops all but the last ``keep`` versions, and the data folders that none of these names: their names."""
        numbers = self._numbers(name)
        kept = [self.manifest(name, n) for n in numbers[-keep:]]
        live = {f["path"].split("/")[0] for m in kept if m for f in m["folders"]}
        inside = {f["path"] for m in kept if m for f in m["folders"]}
        gone = []
        for status in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            folder = status.getPath().getName()
            if not folder.startswith(f"{_FOLDER}="):
                continue
            if folder not in live:
                gone.append(folder)
            elif folder not in inside:  # some of its buckets
                gone += [f"{folder}/{n}" for n in (s.getPath().getName() for s in self._fs.listStatus(status.getPath())) if n.startswith(_BUCKET) and f"{folder}/{n}" not in inside]
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{name}/_m/{n}.json"), False)
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{name}/{folder}"), True)
        return sorted(gone)

    # backups

    def backup(self, names: list[str], target: str) -> dict[str, int]:
        """The tables' rows under ``target`` with a manifest of their counts, which it returns."""
        target, counts = target.rstrip("/"), {}
        for name in names:
            self.read(name).write.mode("errorifexists").parquet(f"{target}/{name}")
            counts[name] = self.spark.read.parquet(f"{target}/{name}").count()
        self.spark.createDataFrame(list(counts.items()), "name string, n long").coalesce(1).write.json(f"{target}/_manifest.json")
        return counts

    def restore(self, names: list[str], source: str, *, safety: str | None = None) -> None:
        """A backup as the new state, after its manifest is checked; nothing is changed where a table is missing or has
        another count. With ``safety`` the state before is backed up there first; it also stays as the version before."""
        source = source.rstrip("/")
        counts = dict(self.spark.read.schema("name string, n long").json(f"{source}/_manifest.json").collect())  # a row a table
        rows = {}
        for name in names:
            if name not in counts:
                raise FileNotFoundError(f"the backup has no table {name}")
            rows[name] = self.spark.read.parquet(f"{source}/{name}")
            if rows[name].count() != counts[name]:
                raise ValueError(f"the backup of {name} isn't whole")
        if safety is not None:
            self.backup([n for n in names if self.exists(n)], safety)
        for name in names:
            base = self.manifest(name) or {"keys": None, "partition": None}
            self.write(name, rows[name], keys=base["keys"], partition=base["partition"])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share. In local mode alone a temporary
    folder will do where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-quern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows written once as Parquet into a shared folder and read from there, so that later steps prune columns and a
    lost executor costs no more than a file. Also keeps the optimizer from pushing a filter on a derived column into a
    copy of its whole expression."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key isn't among the new ones, and the new ones."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows, and the new ones whose key they lack, once each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def fill_detail(old: DataFrame, new: DataFrame, key: str, strategy: str) -> DataFrame:
    """Detail rows merged column by column: ``overwrite`` or ``fill_empty``; other strategies only add missing rows."""
    columns = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full")
    pick = {"overwrite": lambda c: F.coalesce(f"n.{c}", f"o.{c}"), "fill_empty": lambda c: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), f"n.{c}", f"o.{c}")}
    return both.select(key, *(pick.get(strategy, lambda c: F.coalesce(f"o.{c}", f"n.{c}"))(c).alias(c) for c in columns))


def set_status(items: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return items.join(hit, "id", "left").withColumn("data_status", F.when(F.col("_hit"), status).otherwise(F.col("data_status"))).drop("_hit")


def add_tags(items: DataFrame, ids: DataFrame, tags: str) -> DataFrame:
    """Sorted union of the old and new tags of the named items."""
    from quernstone.functions import text as T

    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    both = F.array_join(F.array_sort(F.array_distinct(F.concat(T.split_terms(F.coalesce("tags", F.lit(""))), T.split_terms(F.lit(tags))))), "，")
    return items.join(hit, "id", "left").withColumn("tags", F.when(F.col("_hit"), both).otherwise(F.col("tags"))).drop("_hit")


def csv_cell(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as one CSV line, columns in sorted order."""
    cells = [csv_cell(F.col(c)) for c in sorted(df.columns)]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def export_csv(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def export_recent(log: DataFrame, path: str, limit: int = 10_000) -> None:
    log.orderBy(F.desc("ts"), F.desc("id")).limit(limit).write.json(path)


def latest(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key by the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
