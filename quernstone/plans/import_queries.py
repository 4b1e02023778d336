"""Staging, validation, cleaning, plans and reports over carriers of schemaless rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import values as V
from quernstone.operators import imports, profile, resolve
from quernstone.operators.store import materialized
from quernstone.plans.registry import query, table

ROW_SQL = """r AS (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'herb' WHEN 2 THEN '中药' WHEN 3 THEN 'planet' ELSE 'note' END AS kind,
  CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'Item ' || user_id END AS name, CASE event_id % 4 WHEN 0 THEN 'st' || user_id WHEN 1 THEN ' ' || user_id ELSE '' END AS code FROM events)"""


def staged_rows(spark, sf_dir):
    """Import rows carried by events: some blank, some of unknown type, codes in lower case."""
    e = table(spark, sf_dir, "events")
    k5, k4 = F.col("event_id") % 5, F.col("event_id") % 4
    kind = F.when(k5 == 0, "").when(k5 == 1, "herb").when(k5 == 2, "中药").when(k5 == 3, "planet").otherwise("note")
    name = F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.concat(F.lit("Item "), "user_id"))
    code = F.when(k4 == 0, F.concat(F.lit("st"), "user_id")).when(k4 == 1, F.concat(F.lit(" "), "user_id")).otherwise("")
    record = F.map_from_arrays(F.array(*map(F.lit, ["type", "name", "code", "tags"])), F.array(kind, name, code, F.concat("event_type", F.lit("；x, "), "event_type")))
    return e.select(F.col("event_id").alias("row_index"), record.alias("record"))


@query("WITH " + ROW_SQL + """,
n AS (SELECT event_id, nullif(kind, '') AS kind, nullif(trim(name), '') AS name, nullif(upper(trim(code)), '') AS code FROM r),
i AS (SELECT *, kind IS NULL AS e1, name IS NULL AS e2, coalesce(kind NOT IN ('herb', '中药', 'note'), false) AS e3, coalesce(NOT regexp_matches(code, '^[A-Z][A-Z0-9_-]*$'), false) AS e4 FROM n)
SELECT event_id AS row_index, CASE WHEN e1 OR e2 OR e3 OR e4 THEN 'error' ELSE 'valid' END AS status, (e1::INT + e2::INT + e3::INT + e4::INT) AS n_issues,
  nullif(concat_ws('; ', CASE WHEN e1 THEN 'type is required' END, CASE WHEN e2 THEN 'name is required' END, CASE WHEN e3 THEN 'type is not allowed' END, CASE WHEN e4 THEN 'code is malformed' END), '') AS error_message FROM i
""")
def issue_status(spark, sf_dir):
    s = imports.stage(staged_rows(spark, sf_dir))
    return s.select("row_index", "status", F.size("issues").alias("n_issues"), "error_message")


@query("WITH " + ROW_SQL + """
SELECT event_id AS row_index, nullif(upper(trim(code)), '') AS code, event_type || ',x,' || event_type AS tags, nullif(trim(name), '') AS name FROM r
""")
def normalized_rows(spark, sf_dir):
    n = imports.normalize_record(F.col("record"))
    return staged_rows(spark, sf_dir).select("row_index", *(F.try_element_at(n, F.lit(k)).alias(k) for k in ("code", "tags", "name")))


@query("WITH " + ROW_SQL + """
SELECT event_id AS row_index, unnest(['type', 'name', 'code', 'tags']) AS field, unnest([kind, name, code, event_type || '；x, ' || event_type]) AS old_value,
  unnest([nullif(kind, ''), nullif(trim(name), ''), nullif(upper(trim(code)), ''), event_type || ',x,' || event_type]) AS new_value FROM r
""")
def clean_step_log(spark, sf_dir):
    """Fields before and after the full normalization, with those that stay."""
    rows = staged_rows(spark, sf_dir).withColumn("normalized", F.col("record"))
    after, log = imports.clean_step(rows, "normalize_all")
    same = after.select("row_index", F.explode(F.array(*map(F.lit, ["type", "name", "code", "tags"]))).alias("field"), "record", "normalized")
    kept = same.select("row_index", "field", F.try_element_at("record", F.col("field")).alias("old_value"), F.try_element_at("normalized", F.col("field")).alias("new_value"))
    unchanged = kept.where(F.col("old_value").eqNullSafe(F.col("new_value")))
    return log.unionByName(unchanged)


@query("WITH " + ROW_SQL + """
SELECT event_id AS row_index, kind AS type, name, code FROM r
""")
def undo_clean_step(spark, sf_dir):
    rows = staged_rows(spark, sf_dir).withColumn("normalized", F.col("record"))
    after, log = imports.clean_step(rows, "normalize_all")
    back = imports.undo_step(after, log)
    return back.select("row_index", *(F.try_element_at("normalized", F.lit(k)).alias(k) for k in ("type", "name", "code")))


@query("WITH " + ROW_SQL + """
SELECT 'type' AS field, 1.0::DOUBLE AS coverage, (count(*) FILTER (trim(kind) = ''))::BIGINT AS n_empty FROM r
UNION ALL SELECT 'code', 1.0, count(*) FILTER (trim(code) = '') FROM r UNION ALL SELECT 'name', 1.0, count(*) FILTER (trim(name) = '') FROM r
UNION ALL SELECT 'category', 0.0, 0 UNION ALL SELECT 'summary', 0.0, 0 UNION ALL SELECT 'content', 0.0, 0 UNION ALL SELECT 'source_note', 0.0, 0 UNION ALL SELECT 'tags', 1.0, 0
""")
def field_profile(spark, sf_dir):
    return profile.field_profile(staged_rows(spark, sf_dir))


@query("WITH " + ROW_SQL + """,
f AS (SELECT lower(trim(kind) || '|' || trim(code) || '|' || trim(name) || '|') AS f FROM r),
n AS (SELECT nullif(kind, '') AS kind, nullif(trim(name), '') AS name, nullif(upper(trim(code)), '') AS code FROM r),
e AS (SELECT kind IS NULL OR name IS NULL OR kind NOT IN ('herb', '中药', 'note') OR coalesce(NOT regexp_matches(code, '^[A-Z][A-Z0-9_-]*$'), false) AS bad FROM n)
SELECT count(*)::BIGINT AS n_rows, (count(*) FILTER (NOT bad))::BIGINT AS n_valid, (count(*) FILTER (bad))::BIGINT AS n_error, (SELECT count(*) - count(DISTINCT f) FROM f)::BIGINT AS n_duplicate FROM e
""")
def quality_report(spark, sf_dir):
    s = imports.stage(staged_rows(spark, sf_dir))
    f = resolve.import_fingerprint(*(F.try_element_at("record", F.lit(k)) for k in ("type", "code", "name", "source_note")))
    return profile.quality_report(s, f).select("n_rows", "n_valid", "n_error", "n_duplicate")


PLAN_SQL = """e AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
i AS (SELECT min(doc_id) AS id, lang AS type, source AS name FROM e GROUP BY 2, 3),
x AS (SELECT lang AS type, source AS name, text AS source_note, min(doc_id) AS id FROM e GROUP BY 1, 2, 3),
d AS (SELECT doc_id, lang AS type, CASE WHEN doc_id % 10 = 1 THEN '' ELSE source END AS name, CASE WHEN doc_id % 14 = 3 THEN NULL ELSE text END AS content, text AS source_note FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
f AS (SELECT d.*, coalesce(x.id, i.id) AS existing_id FROM d LEFT JOIN x USING (type, name, source_note) LEFT JOIN i USING (type, name)),
o AS (SELECT f.*, old.text AS old_content, regexp_replace(lower(coalesce(f.content, '')), '\\s+', '', 'g') AS a, regexp_replace(lower(coalesce(old.text, '')), '\\s+', '', 'g') AS b, old.text AS old_source FROM f LEFT JOIN documents old ON old.doc_id = existing_id),
p AS (SELECT *, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS similar_ FROM o)"""


def plan_carriers(spark, sf_dir):
    """Labelled documents as existing items, all others as drafts; some drafts lack name or content."""
    d, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    items = d.join(known, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("name"), F.col("text").alias("content"), F.col("text").alias("source_note"))
    drafts = d.join(known, "doc_id", "left_anti").select(
        F.col("doc_id").alias("row_index"), F.col("lang").alias("type"), F.when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("source")).alias("name"),
        F.when(F.col("doc_id") % 14 != 3, F.col("text")).alias("content"), F.col("text").alias("source_note"),
    )
    return drafts, items


@query("WITH " + PLAN_SQL + """
SELECT doc_id AS row_index, existing_id, CASE WHEN name = '' OR content IS NULL OR trim(content) = '' THEN 'reject_invalid' WHEN existing_id IS NULL THEN 'create_new' WHEN similar_ OR source_note = old_source THEN 'skip_duplicate' ELSE 'create_new' END AS action,
 CASE WHEN name = '' OR content IS NULL OR trim(content) = '' THEN 0.0 WHEN existing_id IS NULL THEN 0.92 WHEN similar_ OR source_note = old_source THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM p
""")
def plan_actions(spark, sf_dir):
    drafts, items = plan_carriers(spark, sf_dir)
    return imports.plan(drafts, items, "classic_text").select("row_index", "existing_id", "action", "confidence")


@query("WITH " + PLAN_SQL + """,
q AS (SELECT CASE WHEN name = '' OR content IS NULL OR trim(content) = '' THEN 'reject_invalid' WHEN existing_id IS NULL THEN 'create_new' WHEN similar_ THEN 'skip_duplicate' ELSE 'attach_annotation' END AS action FROM p)
SELECT action, count(*)::BIGINT AS n FROM q GROUP BY 1
""")
def plan_summary(spark, sf_dir):
    drafts, items = plan_carriers(spark, sf_dir)
    return imports.plan(drafts, items, "annotation_enrichment").groupBy("action").agg(F.count("*").alias("n"))


@query("WITH " + PLAN_SQL + """,
c AS (SELECT doc_id, type, name FROM p WHERE name <> '' AND content IS NOT NULL AND trim(content) <> '' AND (existing_id IS NULL OR NOT (similar_ OR source_note = old_source))),
m AS (SELECT max(doc_id) AS top FROM e)
SELECT doc_id AS id, lang AS type, source AS name FROM e UNION ALL SELECT top + row_number() OVER (ORDER BY doc_id), type, name FROM c, m
""")
def plan_executed(spark, sf_dir):
    drafts, items = plan_carriers(spark, sf_dir)
    after, _, _ = imports.execute(imports.plan(drafts, items, "classic_text"), items, 1)
    return after.select("id", "type", "name")


@query("SELECT doc_id AS id, lang AS type, source AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def plan_rolled_back(spark, sf_dir):
    drafts, items = plan_carriers(spark, sf_dir)
    after, _, log = imports.execute(imports.plan(drafts, items, "classic_text"), items, 1)
    return imports.rollback(items, after, log, after.select(items.columns)).select("id", "type", "name")


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), event_type) AS first_, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n,
  '{"raw_detail":"' || event_type || '","parse_error":true}' AS wrapped FROM events
""")
def json_stage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    wrapped = V.object_or_wrapped("event_type")
    parts = F.to_json(F.struct(F.variant_get(wrapped, "$.raw_detail", "string").alias("raw_detail"), F.variant_get(wrapped, "$.parse_error", "boolean").alias("parse_error")))
    return e.select("event_id", k.alias("k"), F.coalesce(V.json_text("props", "$.missing", "$.k"), "event_type").alias("first_"), V.lenient_long(k).alias("n"), parts.alias("wrapped"))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'acupuncture' WHEN 'de' THEN 'herb' WHEN 'fr' THEN 'syndrome' ELSE 'note' END AS kind, CASE lang WHEN 'en' THEN source WHEN 'de' THEN source WHEN 'fr' THEN lang ELSE source END AS name FROM documents
""")
def canonical_keys(spark, sf_dir):
    from quernstone.functions.text import canonical_key

    d = table(spark, sf_dir, "documents")
    key = F.when(F.col("lang") == "en", F.concat(F.lit("acupoint:"), "source")).when(F.col("lang") == "de", F.concat(F.lit("herb:x:"), "source")).when(F.col("lang") == "fr", F.concat(F.lit("classic_passage:book:"), "lang", F.lit(":001"))).otherwise(F.col("source"))
    kind, name = canonical_key(key)
    return d.select("doc_id", kind.alias("kind"), name.alias("name"))


@query("""
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'classic' WHEN 1 THEN '方剂' WHEN 2 THEN 'herb' ELSE 'weird' END AS kind, source, text FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'theory' WHEN 1 THEN 'formula' WHEN 2 THEN 'herb' ELSE 'note' END AS type, CASE WHEN doc_id % 4 = 2 THEN NULL ELSE kind END AS original_type,
  source || ',' || CASE doc_id % 4 WHEN 0 THEN 'theory' WHEN 1 THEN 'formula' WHEN 2 THEN 'herb' ELSE 'note' END AS tags, 'pending_review' AS data_status, md5(substring(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), 1, 80)) AS summary_md5 FROM r
""")
def import_defaults(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "classic").when(k == 1, "方剂").when(k == 2, "herb").otherwise("weird")
    record = imports.with_defaults(F.map_from_arrays(F.array(*map(F.lit, ["type", "name", "content", "data_status"])), F.array(kind, F.col("source"), F.col("text"), F.lit("odd"))))
    get = (lambda f: F.try_element_at(record, F.lit(f)))
    return d.select("doc_id", get("type").alias("type"), F.get_json_object(get("detail"), "$.original_type").alias("original_type"), get("tags").alias("tags"), get("data_status").alias("data_status"), F.md5(get("summary")).alias("summary_md5"))


@query()
def mapping_scores(spark, sf_dir):
    """Header mapping of the documents' columns as import rows, and how many rows the mapped fields fill."""
    d = table(spark, sf_dir, "documents")
    record = F.map_from_arrays(F.array(*map(F.lit, ["原文", "来源", "类型", "随机列"])), F.array("text", "source", "lang", F.col("n_chars").cast("string")))
    rows = d.select(F.col("doc_id").alias("row_index"), record.alias("record"))
    scored = imports.score_mapping(rows, "herb")
    mapped = imports.apply_mapping(rows, "herb", scored)
    filled = mapped.select(F.explode("record").alias("field", "value")).groupBy("field").agg(F.count("value").alias("n"))
    told = [(s["target"] or s["source"], round(s["confidence"], 4), s["decision"]) for s in scored]
    return filled.join(F.broadcast(spark.createDataFrame(told, "field string, confidence double, decision string")), "field", "left")


@query("""
SELECT event_id AS row_index, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 4 <> 1 THEN 1 ELSE 0 END)::INT AS n_issues FROM events
""")
def maintenance_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    term, code = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")), F.when(F.col("event_id") % 4 == 1, F.col("user_id").cast("string"))
    record = F.map_from_arrays(F.array(F.lit("term"), F.lit("item_code")), F.array(term, code))
    return e.select(F.col("event_id").alias("row_index"), F.size(imports.maintenance_issues(record, "search_terms_v1")).alias("n_issues"))


@query("WITH " + ROW_SQL + """,
n AS (SELECT event_id, nullif(kind, '') AS kind, nullif(trim(name), '') AS name, nullif(upper(trim(code)), '') AS code FROM r),
g AS (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM n WHERE kind IN ('herb', '中药', 'note') AND name IS NOT NULL AND (code IS NULL OR regexp_matches(code, '^[A-Z][A-Z0-9_-]*$')))
SELECT p_partkey AS id, p_type AS type, p_name AS name FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + k, kind, name FROM g
""")
def confirmed_import(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    staged = materialized(imports.stage(staged_rows(spark, sf_dir)))
    return imports.confirmed(staged, items, 3).select("id", "type", "name")
