"""Import runs by their change log: created items, merged fields and attached annotations, undone and not."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import imports, runs
from quernstone.operators.store import materialized
from quernstone.plans.carriers import table
from quernstone.plans.registry import query

#: Customers are items, orders rows of a plan: by their key they make an item, fill an empty content, or annotate.
CARRIED = """
i AS (SELECT c_custkey AS id, 'herb' AS type, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS content, 'own' AS source_note FROM customer),
p AS (SELECT o_orderkey AS row_index, o_custkey AS existing_id, CASE o_orderkey % 3 WHEN 0 THEN 'create_new' WHEN 1 THEN 'merge_empty_fields' ELSE 'attach_annotation' END AS action, 'row ' || o_orderkey AS name, 'text ' || o_orderkey AS content FROM orders WHERE o_orderkey % 5 = 0),
m AS (SELECT existing_id AS id, min_by(content, row_index) AS filled FROM p WHERE action = 'merge_empty_fields' GROUP BY 1),
n AS (SELECT (SELECT max(id) FROM i) + row_number() OVER (ORDER BY row_index) AS id, name, content FROM p WHERE action = 'create_new'),
a AS (SELECT row_number() OVER (ORDER BY row_index) AS id, existing_id AS item_id, name AS source_title, content FROM p WHERE action = 'attach_annotation')
"""


def ran(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    items = c.select(
        F.col("c_custkey").alias("id"), F.lit("herb").alias("type"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("content"), F.lit("own").alias("source_note"),
    )
    k = F.col("o_orderkey") % 3
    action = F.when(k == 0, "create_new").when(k == 1, "merge_empty_fields").otherwise("attach_annotation")
    planned = o.select(
        F.col("o_orderkey").alias("row_index"), F.col("o_custkey").alias("existing_id"), action.alias("action"), F.lit("herb").alias("type"),
        F.concat(F.lit("row "), "o_orderkey").alias("name"), F.concat(F.lit("text "), "o_orderkey").alias("content"), F.lit("imported").alias("source_note"),
    )
    none = spark.createDataFrame([], "id long, item_id long, source_title string, source_note string, content string, detail_json string")
    after, notes, log = runs.run_plan(planned, items, none, 1)
    return items, materialized(after, "after"), materialized(notes, "after-notes"), materialized(log, "log")


def told(items, notes):
    return items.select(F.lit("item").alias("entity"), "id", "name", "content").unionByName(notes.select(F.lit("annotation").alias("entity"), "id", F.col("source_title").alias("name"), "content"))


@query("WITH " + CARRIED + """
SELECT 'item' AS entity, i.id, name, CASE WHEN trim(content) = '' THEN coalesce(filled, content) ELSE content END AS content FROM i LEFT JOIN m USING (id)
UNION ALL SELECT 'item', id, name, content FROM n UNION ALL SELECT 'annotation', id, source_title, content FROM a
""")
def run_executed(spark, sf_dir):
    _, items, notes, _ = ran(spark, sf_dir)
    return told(items, notes)


@query("WITH " + CARRIED + "SELECT 'item' AS entity, id, name, content FROM i")
def run_undone_twice(spark, sf_dir):
    """Created items and annotations are gone and merged fields empty again; undoing once more changes nothing."""
    _, items, notes, log = ran(spark, sf_dir)
    return told(*runs.undo_run(*runs.undo_run(items, notes, log, 1), 1)[:2])


@query("WITH " + CARRIED + """,
o AS (SELECT 'create_new' AS action, 'item' AS entity, id FROM n UNION ALL SELECT 'merge_empty_fields', 'item', id FROM m JOIN i USING (id) UNION ALL SELECT 'attach_annotation', 'annotation', id FROM a)
SELECT action, CASE WHEN id % 4 = 1 THEN 'changed_since' ELSE 'rolled_back' END AS status, count(*)::BIGINT AS n FROM o GROUP BY 1, 2
""")
def run_changed_since(spark, sf_dir):
    """Entities that were changed after the run stay as they are, and the log tells which."""
    _, items, notes, log = ran(spark, sf_dir)
    changed = F.when(F.col("id") % 4 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    _, _, after = runs.undo_run(items.withColumn("content", changed), notes.withColumn("content", changed), log, 1)
    return after.groupBy("action", "status").agg(F.count("*").alias("n"))


@query("WITH " + CARRIED + """
SELECT 'item' AS entity, i.id, name, CASE WHEN i.id % 4 = 1 THEN CASE WHEN trim(content) = '' THEN coalesce(filled, content) ELSE content END || '!' ELSE content END AS content FROM i LEFT JOIN m USING (id)
UNION ALL SELECT 'item', id, name, content || '!' FROM n WHERE id % 4 = 1 UNION ALL SELECT 'annotation', id, source_title, content || '!' FROM a WHERE id % 4 = 1
""")
def run_undone_around_changes(spark, sf_dir):
    _, items, notes, log = ran(spark, sf_dir)
    changed = F.when(F.col("id") % 4 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return told(*runs.undo_run(items.withColumn("content", changed), notes.withColumn("content", changed), log, 1)[:2])


@query()
def header_mapping(spark, sf_dir):
    """Headers that are fields with letters of the documents before or behind, mapped by the mapping service's rule. Its
    similarity halves odd transpositions, which SQL's doesn't: a test holds the rows to a loop over all fields."""
    d = table(spark, sf_dir, "documents")
    letters = F.regexp_replace("text", "[^a-zA-Z]", "")
    key = F.get(F.array(*(F.lit(T.header_key_text(f)) for f in imports.TARGET_FIELDS)), (F.col("doc_id") % 60).cast("int"))
    each = F.array(F.concat(F.lower(F.substring(letters, 1, 6)), key), F.concat(key, F.lower(F.substring(letters, 1, 3))))
    headers = d.select(F.explode(each).alias("header")).where("header is not null")
    return imports.auto_mapping(headers)
