"""Versions, diffs, user state, jobs and item bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T

from quernstone.functions import values as V


def number_versions(changes: DataFrame, item: str = "item_id", at: str = "changed_at", tie: str = "id") -> DataFrame:
    return changes.withColumn("version_no", F.row_number().over(Window.partitionBy(item).orderBy(at, tie)))


def with_snapshot(items: DataFrame, versions: DataFrame) -> DataFrame:
    """A new version row for each item: its snapshot under the next number."""
    last = versions.groupBy("item_id").agg(F.max("version_no").alias("last"))
    fields = [F.col(c) for c in sorted(items.columns)]
    return items.join(last, items.id == last.item_id, "left").select(
        F.col("id").alias("item_id"), (F.coalesce("last", F.lit(0)) + 1).alias("version_no"), F.to_json(F.struct(*fields)).alias("snapshot")
    )


def version_diff(a: Column, b: Column) -> Column:
    """Of two JSON objects: (field, old_value, new_value) where they differ; version a is the new side."""
    as_map = (lambda c: F.from_json(c, "map<string,string>"))
    return V.diff(as_map(b), as_map(a))


def snapshot_item(snapshot: Column) -> Column:
    """The item of a snapshot, which holds it either at the top or under ``item``."""
    return F.coalesce(F.get_json_object(snapshot, "$.item"), snapshot)


def rolled_back(items: DataFrame, versions: DataFrame, item_id, version_no) -> DataFrame:
    """Items with one of them as it was in that version."""
    schema = items.schema
    old = versions.where((F.col("item_id") == item_id) & (F.col("version_no") == version_no))
    was = old.select(F.from_json(snapshot_item(F.col("snapshot")), schema).alias("r")).select("r.*")
    return items.join(was.select("id"), "id", "left_anti").unionByName(was)


def recent(views: DataFrame, k: int | None = 10) -> DataFrame:
    """The latest view of each item, newest first; k is kept within 1 and 50."""
    last = views.groupBy("item_id").agg(F.max("viewed_at").alias("viewed_at"))
    return last.orderBy(F.desc("viewed_at"), "item_id").limit(min(max(k or 10, 1), 50))


def toggle(favorites: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Favorites with these items added where they were absent and removed where they were there."""
    kept = favorites.join(item_ids, "item_id", "left_anti")
    return kept.unionByName(item_ids.join(favorites.select("item_id"), "item_id", "left_anti"), allowMissingColumns=True)


#: States of a job and which may follow.
JOB_STATES = {"pending": ["running", "failed"], "running": ["running", "success", "failed"], "success": [], "failed": []}


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, progress) after each job's events (seq, status, progress), those that don't follow ignored."""
    seen = F.array_sort(F.collect_list(F.struct("seq", "status", "progress")))
    follows = F.create_map(*(x for s, n in JOB_STATES.items() for x in (F.lit(s), F.array(*map(F.lit, n)).cast("array<string>"))))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0.0).alias("progress"))
    end = F.aggregate(
        seen, start,
        lambda a, e: F.when(
            F.array_contains(F.element_at(follows, a["status"]), e["status"]),
            F.struct(e["status"].alias("status"), V.clamp(F.when(e["status"] == "success", 100.0).otherwise(e["progress"]), 0.0, 100.0).alias("progress")),
        ).otherwise(a),
    )
    return events.groupBy("job_id").agg(end.alias("s")).select("job_id", "s.status", "s.progress")


def bundle(items: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Items with an array column for each part (rows with item_id), sorted by the named columns first."""
    out = items
    for name, (rows, order) in parts.items():
        rest = [c for c in rows.columns if c != "item_id" and c not in order]
        lists = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(lists.withColumnRenamed("item_id", "id"), "id", "left")
    return out


def budget(rows: DataFrame, key: str, order: list, length: Column, limit: int) -> DataFrame:
    """Rows of each key until its lengths reach the limit, with ``room``: what is left for the last of them."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(length).over(before), F.lit(0))
    return rows.withColumn("used", used).where(F.col("used") < limit).withColumn("room", F.least(length, F.lit(limit) - F.col("used")))


def first_seen(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def distinct_sources(sources: Column) -> Column:
    """An array of (title, note) structs without blank titles and notes both, each pair once, the first stays."""
    kept = F.filter(F.transform(sources, lambda s: F.struct(T.strip(F.coalesce(s["title"], F.lit(""))).alias("title"), T.strip(F.coalesce(s["note"], F.lit(""))).alias("note"))), lambda s: (s["title"] != "") | (s["note"] != ""))
    return F.array_distinct(kept)


def time_stamps(at) -> tuple[Column, Column]:
    """A time, without zone, as ids are made of it: fourteen digits, and milliseconds since 1970."""
    plain = T.col(at).cast("timestamp_ntz")
    return F.date_format(plain, "yyyyMMddHHmmss"), F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), plain)
