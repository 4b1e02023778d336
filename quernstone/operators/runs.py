"""Import runs that can be undone: a change log with the images of each entity before and after.

An image is the entity's row as JSON, nulls included. Undoing a run takes its entities one by one: where the entity still is what
the run left, it goes back to what it was before the run's first change of it (or goes, if the run made it); where it was changed
since, it stays and the log says so. A run that was undone has no open changes left, so that undoing it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import imports
from quernstone.operators.store import materialized

#: Columns of the log.
LOG = "run_id long, row_index long, action string, entity string, entity_id long, before string, after string, status string"
ANNOTATION = ["item_id", "source_title", "source_note", "content", "detail_json"]


def image(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def _logged(rows: DataFrame, run_id: int, action: str, entity: str, entity_id: Column, before: Column, after: Column) -> DataFrame:
    return rows.select(
        F.lit(run_id).cast("long").alias("run_id"), "row_index", F.lit(action).alias("action"), F.lit(entity).alias("entity"),
        entity_id.alias("entity_id"), before.cast("string").alias("before"), after.cast("string").alias("after"), F.lit("done").alias("status"),
    )


def run_plan(planned: DataFrame, items: DataFrame, annotations: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, annotations, change log) after a plan.

    New items and annotations are numbered after the largest id, in the order of their rows; of the rows that merge into one
    item the first counts, and only empty fields are filled. ``annotations`` has id and the columns of ``ANNOTATION``.
    """
    fields = [c for c in imports.ITEM_FIELDS if c in planned.columns]
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = imports.numbered(planned.where("action = 'create_new'"), "row_index").crossJoin(F.broadcast(top))  # top: one row
    made = materialized(made.select((F.col("top") + F.col("number")).alias("id"), *fields, "row_index"), "made")
    first = planned.where("action = 'merge_empty_fields'").groupBy(F.col("existing_id").alias("id")).agg(F.min_by(F.struct(*fields, "row_index"), "row_index").alias("new"))
    filled = [c for c in fields if c in items.columns and c not in ("type", "name")]
    both = items.withColumn("before", image(items.columns)).join(first, "id").withColumn("row_index", F.col("new.row_index"))
    merged = both.withColumns({c: F.coalesce(T.blank_to_null(c), F.col(f"new.{c}"), F.col(c)) for c in filled})
    merged = materialized(merged.withColumn("after", image(items.columns)).drop("new"), "merged")
    last = annotations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    notes = imports.numbered(planned.where("action = 'attach_annotation'"), "row_index").crossJoin(F.broadcast(last))  # last: one row
    notes = notes.select(
        (F.col("top") + F.col("number")).alias("id"), F.col("existing_id").alias("item_id"), F.col("name").alias("source_title"), "source_note", "content",
        F.to_json(F.struct(*planned.columns)).alias("detail_json"), "row_index",
    )
    notes = materialized(notes, "notes")
    full = made.select(*(F.col(c) if c in made.columns else F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns), "row_index")
    log = _logged(full.withColumn("after", image(items.columns)), run_id, "create_new", "item", F.col("id"), F.lit(None), F.col("after"))
    log = log.unionByName(_logged(merged, run_id, "merge_empty_fields", "item", F.col("id"), F.col("before"), F.col("after")))
    log = log.unionByName(_logged(notes.withColumn("after", image(["id", *ANNOTATION])), run_id, "attach_annotation", "annotation", F.col("id"), F.lit(None), F.col("after")))
    kept = items.join(merged.select("id"), "id", "left_anti").unionByName(merged.select(items.columns)).unionByName(full.select(items.columns))
    return kept, annotations.unionByName(notes.select("id", *ANNOTATION), allowMissingColumns=True), log


def _undone(now: DataFrame, columns: list[str], changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the changes were taken back, (entity_id, status) of each entity)."""
    met = now.withColumn("_now", image(columns)).join(changes, F.col("id") == F.col("entity_id"), "left")
    held = F.coalesce(F.col("_now") == F.col("after"), F.lit(False))
    met = materialized(met.withColumn("_held", held), "undone")
    stay = met.where("not _held").select(now.columns)
    back = met.where("_held and before is not null").select(*(F.col(c) for c in now.columns if c not in columns), F.from_json("before", now.select(columns).schema).alias("_b"))
    back = back.select(*(F.col(f"_b.{c}").alias(c) if c in columns else F.col(c) for c in now.columns))
    seen = met.where("_held").select("entity_id", F.lit("rolled_back").alias("status"))
    return stay.unionByName(back), seen


def undo_run(items: DataFrame, annotations: DataFrame, log: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, annotations, log) with a run undone. Its changes end as ``rolled_back``, or as ``changed_since`` where the entity
    isn't what the run left (an entity that is gone, too). Several changes of an entity are undone from the last to the first."""
    open_ = (F.col("run_id") == run_id) & (F.col("status") == "done")
    order = F.struct("row_index", "action")
    changes = log.where(open_).groupBy("entity", "entity_id").agg(F.min_by(F.struct("before"), order).alias("_first"), F.max_by("after", order).alias("after"))
    changes = materialized(changes.select("entity", "entity_id", F.col("_first.before").alias("before"), "after"), "changes")
    items_after, seen_items = _undone(items, items.columns, changes.where("entity = 'item'").drop("entity"))
    notes_after, seen_notes = _undone(annotations, ["id", *ANNOTATION], changes.where("entity = 'annotation'").drop("entity"))
    seen = seen_items.withColumn("entity", F.lit("item")).unionByName(seen_notes.withColumn("entity", F.lit("annotation")))
    told = log.join(seen.withColumnRenamed("status", "_to"), ["entity", "entity_id"], "left")
    status = F.when(open_, F.coalesce("_to", F.lit("changed_since"))).otherwise(F.col("status"))
    return items_after, notes_after, told.withColumn("status", status).select(log.columns)
