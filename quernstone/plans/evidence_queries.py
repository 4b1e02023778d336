"""Operators that the other query modules don't reach: validation against items, confirmations, lists, files, adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import udfs
from quernstone.functions import values as V
from quernstone.operators import curate, history, imports, profile, relations, resolve, search, store
from quernstone.plans.import_queries import ROW_SQL, staged_rows
from quernstone.plans.carriers import part_index, table
from quernstone.plans.registry import query


def record_of(**values):
    """A record column of these fields; null values have no key."""
    pairs = F.array(*(F.struct(F.lit(k), v.cast("string")) for k, v in values.items()))
    return F.map_filter(F.map_from_entries(pairs), lambda k, v: v.isNotNull())


def field(name, column="record"):
    return F.try_element_at(column, F.lit(name))


# mapping


@query("""
SELECT event_id AS row_index, 'Item ' || user_id AS name, CASE WHEN event_id % 50 = 27 THEN event_type END AS effects, CASE WHEN event_id % 50 = 28 THEN 'st' || user_id END AS code,
  CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS source_note FROM events
""")
def late_headers(spark, sf_dir):
    """Headers that rows far down bring are mapped by alias; of two sources of a field the first in sorted order wins."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 50
    record = record_of(
        名称=F.concat(F.lit("Item "), "user_id"), 功效=F.when(k == 27, F.col("event_type")), 穴号=F.when(k == 28, F.concat(F.lit("st"), "user_id")),
        source=F.when(F.col("event_id") % 3 == 0, "a"), source_note=F.lit("b"), 无关=F.lit("x"),
    )
    rows = e.select(F.col("event_id").alias("row_index"), record.alias("record"))
    mapped = imports.apply_mapping(rows, "herb", imports.score_mapping(rows, "herb"))
    return mapped.select("row_index", *(field(f).alias(f) for f in ("name", "effects", "code", "source_note")))


@query("""
SELECT event_id AS row_index, coalesce(CASE WHEN event_id % 2 = 0 THEN 'own' END, event_type) AS effects, user_id::VARCHAR AS odd_key, 'note' || coalesce(' / ' || CASE WHEN event_id % 3 = 0 THEN 'page ' || user_id END, '') AS source_note FROM events
""")
def lifted_detail(spark, sf_dir):
    """Keys of the detail lifted beside the record's own, by alias; context fields end in the source note."""
    e = table(spark, sf_dir, "events")
    page = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("page "), "user_id"))
    detail = F.to_json(F.struct(F.col("event_type").alias("功效"), F.col("user_id").cast("string").alias("odd_key"), page.alias("page_title")))
    record = record_of(effects=F.when(F.col("event_id") % 2 == 0, "own"), source_note=F.lit("note"), detail=detail)
    rows = e.select(F.col("event_id").alias("row_index"), imports.lift_detail(record).alias("record"))
    return rows.select("row_index", *(field(f).alias(f) for f in ("effects", "odd_key", "source_note")))


@query("""
WITH k AS (SELECT unnest(['名称', '分类', '来源']) AS h), n AS (SELECT count(*) AS n FROM events)
SELECT h AS header, least(n, 100)::BIGINT AS n_preview FROM k, n UNION ALL SELECT 'rare', least(n, 100)::BIGINT FROM n WHERE EXISTS (SELECT 1 FROM events WHERE event_id % 97 = 96)
""")
def file_preview(spark, sf_dir):
    """Headers over all rows, and the number of rows that a preview shows."""
    e = table(spark, sf_dir, "events")
    record = record_of(名称=F.col("event_type"), 分类=F.lit("x"), 来源=F.lit("book"), rare=F.when(F.col("event_id") % 97 == 96, "y"))
    shown = imports.preview(e.select(F.col("event_id").alias("row_index"), record.alias("record")), "rows.csv", "csv", "herb")
    headers = spark.createDataFrame([(h,) for h in shown["headers"]], "header string")
    return headers.crossJoin(shown["rows"].agg(F.count("*").alias("n_preview")))  # one row


@query("""
SELECT event_id AS row_index, CASE event_type WHEN 'view' THEN 'syndrome' ELSE 'acupuncture' END AS type, CASE event_type WHEN 'view' THEN 'book ' || user_id || ' - part' ELSE 'p' || user_id END AS name,
  CASE event_type WHEN 'view' THEN '原典 / book ' || user_id ELSE '人纪注解' END AS category, CASE event_type WHEN 'view' THEN 'validated' ELSE 'imported' END AS data_status,
  CASE event_type WHEN 'view' THEN 'book ' || user_id || ' / part' ELSE 'ref' END AS source_note FROM events
""")
def adapted_records(spark, sf_dir):
    """Classic passages and annotations as item records."""
    e = table(spark, sf_dir, "events")
    passage = record_of(work_title=F.concat(F.lit("book "), "user_id"), section_title=F.lit("part"), original_text=F.col("event_type"))
    note = record_of(canonical_key=F.concat(F.lit("acupoint:"), F.lit("p"), "user_id"), content=F.col("event_type"), page_ref=F.lit("ref"))
    record = F.when(F.col("event_type") == "view", imports.adapt_passage(passage)).otherwise(imports.adapt_annotation(note))
    return e.select(F.col("event_id").alias("row_index"), *(field(f, record).alias(f) for f in ("type", "name", "category", "data_status", "source_note")))


@query("""
SELECT event_id AS row_index, event_type AS term, CASE WHEN event_id % 2 = 0 THEN 'imported' ELSE 'own' END AS term_type, '80' AS weight, CASE WHEN event_id % 2 = 0 THEN 'treats' ELSE 'related_to' END AS relation_type, '0.8' AS confidence FROM events
""")
def adapted_maintenance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    term = imports.ADAPTERS["search_terms_v1"](record_of(关键词=F.col("event_type"), termType=F.when(~even, "own")))
    edge = imports.ADAPTERS["relation_suggestions_v1"](record_of(关系类型=F.when(even, "treats")))
    told = [(term, f) for f in ("term", "term_type", "weight")] + [(edge, f) for f in ("relation_type", "confidence")]
    return e.select(F.col("event_id").alias("row_index"), *(field(f, r).alias(f) for r, f in told))


# validation and staging


def met_rows(spark, sf_dir):
    """Staged rows of which some name a part's type and code or name; acupoints name meridians."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    k = F.col("event_id") % 4
    kind = F.when(k == 3, "acupoint").otherwise("herb")
    record = record_of(
        type=kind, name=F.when(k == 1, F.concat(F.lit("Part "), "user_id")).otherwise(F.concat(F.lit("N"), "event_id")), code=F.when(k == 0, F.concat(F.lit("p-"), "user_id")),
        meridians=F.when(k == 3, F.concat(F.lit("Part "), "user_id")),
    )
    items = p.select(F.col("p_partkey").alias("id"), F.lit("herb").alias("type"), F.concat(F.lit("P"), "p_partkey").alias("code"), F.concat(F.lit("part "), "p_partkey").alias("name"))
    return imports.stage(e.select(F.col("event_id").alias("row_index"), record.alias("record"))), items


MET_SQL = "p AS (SELECT p_partkey FROM part), e AS (SELECT event_id, event_id % 4 AS k, user_id, user_id IN (SELECT p_partkey FROM p) AS known FROM events)"


@query(f"""
WITH {MET_SQL}
SELECT event_id AS row_index, CASE WHEN k IN (0, 1) AND known THEN 'warning' ELSE 'valid' END AS status, CASE WHEN k IN (0, 1) AND known THEN 'possible_existing_duplicate' END AS issue_code, CASE WHEN k = 0 AND known THEN 'code' WHEN k = 1 AND known THEN 'name' END AS field_name FROM e
""")
def existing_duplicates(spark, sf_dir):
    staged, items = met_rows(spark, sf_dir)
    out = imports.check_existing(staged, items)
    first = F.get("issues", F.lit(0))
    return out.select("row_index", "status", first["issue_code"].alias("issue_code"), first["field_name"].alias("field_name"))


@query(f"WITH {MET_SQL} SELECT count(*)::BIGINT AS n_rows FROM e WHERE k IN (0, 1) AND known")
def duplicate_warning_rows(spark, sf_dir):
    staged, items = met_rows(spark, sf_dir)
    return profile.rows_with_issue(imports.check_existing(staged, items))


@query(f"""
WITH {MET_SQL} SELECT event_id AS row_index, CASE WHEN k = 3 AND NOT known THEN 'warning' ELSE 'valid' END AS status FROM e
""")
def missing_references(spark, sf_dir):
    staged, items = met_rows(spark, sf_dir)
    return imports.check_references(staged, items.select(F.initcap("name").alias("name"))).select("row_index", "status")


@query(f"""
WITH {MET_SQL} SELECT event_id AS row_index, 'valid' AS status, 'E' || event_id AS name FROM e
""")
def revalidated_batch(spark, sf_dir):
    """A clean step and a batch validated anew: warnings of earlier joins are gone, errors told anew."""
    staged, items = met_rows(spark, sf_dir)
    n = imports.put(F.col("normalized"), {"name": F.concat(F.lit("E"), "row_index")})
    return imports.validated(imports.check_existing(staged, items).withColumn("normalized", n)).select("row_index", "status", field("name", "normalized").alias("name"))


@query(f"""
WITH {ROW_SQL}, s AS (SELECT event_id, kind = '' OR trim(name) = '' OR kind = 'planet' OR (trim(code) <> '' AND NOT regexp_matches(upper(trim(code)), '^[A-Z][A-Z0-9_-]*$')) AS bad FROM r)
SELECT event_id AS row_index FROM s WHERE bad ORDER BY 1 LIMIT 20 OFFSET 20
""")
def staging_page(spark, sf_dir):
    return imports.staging_page(imports.stage(staged_rows(spark, sf_dir)), "error", 2, 20).select("row_index")


@query("SELECT l_returnflag || l_linestatus AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 8")
def histogram_head(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flag"))
    return profile.first_values(profile.histogram(r, "flag"))


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS items, (SELECT count(*) FROM conversations)::BIGINT AS annotations, (SELECT count(*) FROM orders)::BIGINT AS runs, (SELECT count(*) FROM labels)::BIGINT AS favorites, (SELECT count(*) FROM events)::BIGINT AS views")
def dashboard(spark, sf_dir):
    names = {"items": "part", "annotations": "conversations", "runs": "orders", "favorites": "labels", "views": "events"}
    return profile.table_counts({k: table(spark, sf_dir, t) for k, t in names.items()})


# confirmations


def confirm_state(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.lit(None).cast("int").alias("import_batch_id"))
    terms = p.select(F.col("p_partkey").alias("item_id"), F.lower("p_type").alias("term"), F.lit("category").alias("term_type"), F.lit(55).alias("weight"))
    marks = p.select(F.col("p_partkey").alias("item_id"), F.lower("p_name").alias("fingerprint"))
    attached = F.to_json(F.array(F.struct(F.concat(F.lit("Own "), field("name")).alias("term"), F.lit("alias").alias("term_type"), F.lit("900").alias("weight"))))
    rows = staged_rows(spark, sf_dir).withColumn("record", F.map_concat("record", F.create_map(F.lit("_package_search_terms"), attached)))
    return imports.confirm(store.materialized(imports.stage(rows)), items, terms, marks, 3)


CONFIRM_SQL = ROW_SQL + """,
n AS (SELECT event_id, event_type, user_id, nullif(kind, '') AS kind, nullif(trim(name), '') AS name, nullif(upper(trim(code)), '') AS code FROM (SELECT r.*, user_id FROM r JOIN events USING (event_id))),
g AS (SELECT *, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY event_id) AS id FROM n WHERE kind IN ('herb', '中药', 'note') AND name IS NOT NULL AND (code IS NULL OR regexp_matches(code, '^[A-Z][A-Z0-9_-]*$')))"""


@query(f"""
WITH {CONFIRM_SQL},
t AS (SELECT id, replace(lower(name), ' ', '') AS term, 'imported_package' AS term_type, 80 AS weight FROM g UNION SELECT id, lower(code), 'imported_package', 80 FROM g WHERE code IS NOT NULL
  UNION SELECT id, event_type, 'imported_package', 80 FROM g UNION SELECT id, 'x', 'imported_package', 80 FROM g UNION SELECT id, 'ownitem' || user_id, 'package_alias', 200 FROM g)
SELECT id AS item_id, term, term_type, weight::INT AS weight FROM t UNION ALL SELECT p_partkey, lower(p_type), 'category', 55 FROM part
""")
def confirmed_terms(spark, sf_dir):
    return confirm_state(spark, sf_dir)["terms"].select("item_id", "term", "term_type", "weight")


@query(f"""
WITH {CONFIRM_SQL} SELECT count(*)::BIGINT AS n_rows, (SELECT count(*) FROM g)::BIGINT AS n_imported, (count(*) - (SELECT count(*) FROM g))::BIGINT AS n_skipped FROM n
""")
def confirm_report(spark, sf_dir):
    return confirm_state(spark, sf_dir)["report"]


@query(f"""
WITH {CONFIRM_SQL} SELECT p_partkey AS item_id, lower(p_name) AS fingerprint FROM part
UNION ALL SELECT id, CASE WHEN code IS NULL THEN kind || '|name|' || replace(lower(name), ' ', '') || '|pinyin||category|' ELSE kind || '|code|' || code END FROM g
""")
def confirmed_fingerprints(spark, sf_dir):
    return confirm_state(spark, sf_dir)["fingerprints"]


@query("""
SELECT 'items' AS what, count(*)::BIGINT AS n FROM part UNION ALL SELECT 'terms', count(*) FROM part UNION ALL SELECT 'fingerprints', count(*) FROM part
UNION ALL SELECT 'linked', 0 UNION ALL SELECT 'rows', count(*) FROM events
""")
def confirm_undone(spark, sf_dir):
    """A confirmed batch rolled back: its items, terms and fingerprints are gone, its rows marked."""
    state = imports.undo_confirm(confirm_state(spark, sf_dir), 3)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in state.items()]
    counts.append(state["rows"].agg(F.count("item_id").alias("n")).select(F.lit("linked").alias("what"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def as_staged(rows, record):
    """Rows that were staged without errors, with this record."""
    none = F.lit(None).cast("string")
    return rows.select("row_index", record.alias("normalized"), F.lit("valid").alias("status"), none.alias("error_message"))


@query("""
WITH t AS (SELECT 'segment' AS term_type, c_mktsegment AS standard_name, 'old' AS aliases, NULL AS code, 'n' AS notes FROM customer GROUP BY 2),
r AS (SELECT event_id, 'segment' AS term_type, CASE WHEN event_id % 3 = 0 THEN 'BUILDING' ELSE event_type END AS standard_name, CASE WHEN event_id % 5 = 0 THEN 'a' || event_id END AS aliases, 'c' || event_id AS code FROM events),
n AS (SELECT term_type, standard_name, arg_max(aliases, event_id) FILTER (aliases IS NOT NULL) AS aliases, arg_max(code, event_id) AS code FROM r GROUP BY 1, 2)
SELECT coalesce(t.term_type, n.term_type) AS term_type, coalesce(t.standard_name, n.standard_name) AS standard_name, coalesce(n.aliases, t.aliases) AS aliases, coalesce(n.code, t.code) AS code, t.notes FROM t FULL JOIN n ON t.term_type = n.term_type AND t.standard_name = n.standard_name
""")
def standard_terms_applied(spark, sf_dir):
    none = F.lit(None).cast("string")
    terms = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("standard_name")).agg(F.lit("old").alias("aliases")).select(F.lit("segment").alias("term_type"), "standard_name", "aliases", none.alias("code"), F.lit("n").alias("notes"))
    e = table(spark, sf_dir, "events").withColumn("row_index", F.col("event_id"))
    record = record_of(term_type=F.lit("segment"), standard_name=F.when(F.col("event_id") % 3 == 0, "BUILDING").otherwise(F.col("event_type")), aliases=F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("a"), "event_id")), code=F.concat(F.lit("c"), "event_id"))
    return imports.apply_standard_terms(as_staged(e, record), terms)


def maintenance_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lit("herb").alias("type"), F.concat(F.lit("P"), "p_partkey").alias("code"), F.concat(F.lit("n"), "p_partkey").alias("name"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS term, user_id IN (SELECT p_partkey FROM part) AS known FROM events),
g AS (SELECT user_id AS item_id, term, arg_min(least(greatest(event_id, 1), 500), event_id)::INT AS weight FROM e WHERE known AND term IS NOT NULL GROUP BY 1, 2)
SELECT item_id, term, 'imported' AS term_type, weight FROM g WHERE NOT (item_id % 2 = 0 AND term = 'view') UNION ALL SELECT p_partkey, 'view', 'imported', 9 FROM part WHERE p_partkey % 2 = 0
""")
def search_terms_applied(spark, sf_dir):
    terms, _ = _applied_terms(spark, sf_dir)
    return terms


def _applied_terms(spark, sf_dir):
    p, e = table(spark, sf_dir, "part"), table(spark, sf_dir, "events").withColumn("row_index", F.col("event_id"))
    old = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item_id"), F.lit("view").alias("term"), F.lit("imported").alias("term_type"), F.lit(9).alias("weight"))
    code = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("P"), "user_id"))
    record = record_of(item_code=code, item_name=F.when(code.isNull(), F.concat(F.lit("n"), "user_id")), term=F.when(F.col("event_id") % 7 != 0, F.initcap("event_type")), weight=F.col("event_id"))
    return imports.apply_search_terms(as_staged(e, record), old, maintenance_items(spark, sf_dir))


@query("""
SELECT event_id AS row_index, CASE WHEN user_id NOT IN (SELECT p_partkey FROM part) THEN 'item not found' WHEN event_id % 7 = 0 THEN 'term is required' END AS error_message FROM events
""")
def search_term_errors(spark, sf_dir):
    _, rows = _applied_terms(spark, sf_dir)
    return rows.select("row_index", "error_message")


@query("""
WITH p AS (SELECT p_partkey FROM part), e AS (SELECT event_id, user_id AS s, user_id % 10 + 1 AS t FROM events),
g AS (SELECT s AS source_id, t AS target_id, 'treats' AS relation_type, arg_min(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.8 END, event_id) AS confidence FROM e WHERE s IN (FROM p) AND t IN (FROM p) AND s <> t GROUP BY 1, 2)
SELECT source_id, target_id, relation_type, confidence::DOUBLE AS confidence FROM g WHERE NOT (source_id % 3 = 0 AND target_id = source_id % 10 + 1 AND source_id IN (FROM p))
""")
def suggestions_applied(spark, sf_dir):
    p, e = table(spark, sf_dir, "part"), table(spark, sf_dir, "events").withColumn("row_index", F.col("event_id"))
    edge = [(F.col("p_partkey") if c == "source_id" else F.col("p_partkey") % 10 + 1).alias(c) for c in ("source_id", "target_id")]
    accepted = p.where("p_partkey % 3 = 0").select(*edge, F.lit("treats").alias("relation_type"))
    none = accepted.select("*", F.lit(0.5).alias("confidence"), F.lit("pending").alias("status")).limit(0)
    record = record_of(source_item_id=F.col("user_id"), target_code=F.concat(F.lit("P"), F.col("user_id") % 10 + 1), relation_type=F.lit("treats"), confidence=F.when(F.col("event_id") % 2 == 0, "7"))
    out, _ = imports.apply_suggestions(as_staged(e, record), none, accepted, maintenance_items(spark, sf_dir))
    return out.select("source_id", "target_id", "relation_type", "confidence")


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'formula' ELSE 'herb' END AS type, CASE WHEN event_id % 6 = 1 THEN ' ' ELSE 'G' || event_id END AS name FROM events),
g AS (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM r WHERE type = 'herb' AND trim(name) <> '')
SELECT 'item' AS what, (SELECT max(p_partkey) FROM part) + k AS id, name FROM g UNION ALL SELECT 'item', p_partkey, 'n' || p_partkey FROM part
UNION ALL SELECT CASE WHEN type = 'herb' THEN 'name' ELSE 'item_type' END, event_id, CASE WHEN type = 'herb' THEN 'name is required' ELSE 'row is of another type' END FROM r WHERE type <> 'herb' OR trim(name) = ''
""")
def grid_save(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("row_index"), F.when(F.col("event_type") == "error", "formula").otherwise("herb").alias("type"), F.when(F.col("event_id") % 6 == 1, " ").otherwise(F.concat(F.lit("G"), "event_id")).alias("name"))
    items, errors = imports.save_grid(rows, "herb", maintenance_items(spark, sf_dir))
    return items.select(F.lit("item").alias("what"), "id", "name").unionByName(errors.select(F.col("field_name").alias("what"), F.col("row_index").alias("id"), F.col("message").alias("name")))


# candidates and relations


@query("""
WITH i AS (SELECT p_partkey AS id, p_type AS type, replace(lower(p_name), ' ', '') AS name FROM part), r AS (SELECT DISTINCT p_type AS type, replace(lower(p_name), ' ', '') AS name FROM part WHERE p_partkey % 5 = 0)
SELECT r.type || '/' || r.name AS row_key, i.id AS item_id, 'type_name_exact' AS match_type FROM r JOIN i USING (type, name)
UNION ALL SELECT r.type || '/' || r.name, i.id, 'fingerprint_match' FROM r JOIN i USING (type, name)
""")
def every_candidate(spark, sf_dir):
    """All items that each import row meets, by class and membership."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    rest = [none.alias(c) for c in ("alias", "pinyin", "category", "code")]
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), *rest)
    rows = items.where("id % 5 = 0").groupBy("type", F.lower("name").alias("name")).agg(F.min("id").alias("id")).select("id", "type", "name", *rest)
    links, members = resolve.row_candidates(rows, items)
    pairs = resolve.candidate_pairs(links, members, links.select("row_id").distinct())
    keys = rows.select(F.col("id").alias("row_id"), F.concat("type", F.lit("/"), T.normalize("name")).alias("row_key"))
    return pairs.join(keys, "row_id").select("row_key", "item_id", "match_type")


@query("""
SELECT e.event_id AS id, p.p_name AS item_name, q.p_name AS duplicate_name, c.c_name AS row_name FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id LEFT JOIN part q ON q.p_partkey = e.user_id + 50 LEFT JOIN customer c ON c.c_custkey = CASE WHEN event_id % 2 = 0 THEN e.user_id END
""")
def candidate_list(spark, sf_dir):
    e, p, c = (table(spark, sf_dir, t) for t in ("events", "part", "customer"))
    found = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), (F.col("user_id") + 50).alias("duplicate_id"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("row_id"))
    items, rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return resolve.candidate_list(found, items, rows).select("id", "item_name", "duplicate_name", "row_name")


@query("""
SELECT e.event_id AS id, p.p_name AS source_name, q.p_type AS target_type FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id LEFT JOIN part q ON q.p_partkey = e.event_id
""")
def suggestion_list(spark, sf_dir):
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    edges = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("event_id").alias("target_id"), F.col("value").alias("confidence"))
    return relations.suggestion_list(edges, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))).select("id", "source_name", "target_type")


@query("""
WITH t AS (SELECT p_type AS name, min(p_partkey) AS id FROM part WHERE p_size > 10 GROUP BY 1) SELECT event_id AS ref_id, id AS item_id FROM events LEFT JOIN t ON name = CASE WHEN event_id % 2 = 0 THEN 'ECONOMY' ELSE event_type END
""")
def least_named_item(spark, sf_dir):
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, "meridian").otherwise("herb").alias("type"), F.col("p_type").alias("name"))
    refs = e.select(F.col("event_id").alias("ref_id"), F.when(F.col("event_id") % 2 == 0, "ECONOMY").otherwise(F.col("event_type")).alias("name"))
    return resolve.least_id(refs, items, "meridian")


@query("""
SELECT p_partkey AS id, trim(p_name || ' ' || '' || ' ' || coalesce(f.a, '') || ' ' || coalesce(f.b, '') || ' ' || coalesce(d.a, '') || '  ' || coalesce(d.b, '') || ' ') AS text FROM part
LEFT JOIN (SELECT c_custkey, c_name AS a, c_mktsegment AS b FROM customer WHERE c_custkey % 2 = 0) f ON f.c_custkey = p_partkey LEFT JOIN (SELECT s_suppkey, s_name AS a, 'care' AS b FROM supplier) d ON d.s_suppkey = p_partkey
""")
def detail_texts(spark, sf_dir):
    """Items with the texts of three detail tables in one."""
    p, c, s = (table(spark, sf_dir, t) for t in ("part", "customer", "supplier"))
    none = F.lit(None).cast("string")
    formula = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("composition"), F.col("c_mktsegment").alias("indications"))
    disease = s.select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("symptoms"), none.alias("common_syndromes"), F.lit("care").alias("care_advice"), none.alias("notes"))
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), none.alias("summary"))
    return relations.with_detail_text(items, {"formula": formula, "disease": disease}).select("id", "text")


@query("""
SELECT event_id AS id, CASE WHEN event_id % 5 = 0 AND event_type <> 'error' THEN 'accepted' WHEN event_id % 5 = 1 AND event_type <> 'error' THEN 'rejected' WHEN event_type = 'error' THEN 'old' ELSE 'pending' END AS status FROM events
UNION ALL SELECT DISTINCT -user_id, 'edge' FROM events WHERE event_id % 5 = 0 AND event_type <> 'error'
""")
def decided_suggestions(spark, sf_dir):
    """Suggestions accepted and rejected, and the edges that follow."""
    e = table(spark, sf_dir, "events")
    edges = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.lit(0).cast("long").alias("target_id"), F.lit("t").alias("relation_type"), F.when(F.col("event_type") == "error", "old").otherwise("pending").alias("status"))
    ids = (lambda k: e.where(F.col("event_id") % 5 == k).select(F.col("event_id").alias("id")))
    moved, made = relations.decide(edges, edges.select("source_id", "target_id", "relation_type").limit(0), ids(0), ids(1))
    return moved.select("id", "status").unionByName(made.select((-F.col("source_id")).alias("id"), F.lit("edge").alias("status")))


@query("""
SELECT DISTINCT user_id AS item_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS match_type FROM events WHERE NOT (user_id % 2 = 0 AND event_type = 'view')
""")
def pending_candidates(spark, sf_dir):
    """Candidates that aren't pending yet, null keys being equal."""
    e = table(spark, sf_dir, "events")
    found = e.select(F.col("user_id").alias("item_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("match_type"))
    pending = e.where("user_id % 2 = 0").select(F.col("user_id").alias("item_id"), F.lit(None).cast("string").alias("match_type")).distinct()
    return resolve.new_pending(found, pending, ["item_id", "match_type"]).select("item_id", "match_type")


@query("""
WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS a, c_mktsegment AS b FROM customer), n AS (SELECT o_custkey AS k, max(o_orderpriority) AS a, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'n' END AS b FROM orders GROUP BY 1)
SELECT coalesce(a.k, n.k) AS k, coalesce(nullif(a.a, ''), n.a, a.a) AS a, coalesce(nullif(a.b, ''), n.b, a.b) AS b, coalesce(n.b, a.b) AS over FROM a FULL JOIN n ON a.k = n.k
""")
def filled_detail(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    old = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("a"), F.col("c_mktsegment").alias("b"))
    new = o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("a"), F.when(F.min("o_orderkey") % 2 == 0, "n").alias("b"))
    over = store.fill_detail(old, new, "k", "overwrite").select("k", F.col("b").alias("over"))
    return store.fill_detail(old, new, "k", "fill_empty").join(over, "k")


@query("SELECT n_nationkey AS id, lower(n_name) AS low, row_number() OVER (ORDER BY lower(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END), n_nationkey)::INT AS place FROM nation")
def caseless_order(spark, sf_dir):
    """Neighbours in list order, in either case."""
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").alias("id"), F.lit("r").alias("relation_type"), F.lit("t").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("name"))
    ordered = relations.in_list_order(rows).coalesce(1)  # a list that is read by people: 25 rows
    return ordered.select("id", F.lower("name").alias("low"), (F.monotonically_increasing_id() + 1).cast("int").alias("place"))


# search


@query("""
WITH tok AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '') || list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM part),
e AS (SELECT p_partkey, unnest(toks) AS tok FROM tok)
SELECT tok AS token, count(DISTINCT p_partkey)::BIGINT AS df, count(*)::BIGINT AS tf FROM e GROUP BY 1
""")
def stored_postings(spark, sf_dir):
    """The stored index's postings by token."""
    rows = part_index(spark, sf_dir).live("postings")
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.size("places")).cast("long").alias("tf"))


@query("""
WITH a AS (SELECT conv_id, string_agg('t ' || role || ' ' || text, chr(10) ORDER BY turn) AS notes FROM conversations GROUP BY 1)
SELECT doc_id, md5(text || coalesce(chr(10) || notes, '')) AS content_md5 FROM documents LEFT JOIN a ON conv_id = doc_id
""")
def annotated_content(spark, sf_dir):
    """What an item's annotations add to its indexed content."""
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    notes = c.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("id"), F.lit("t").alias("source_title"), F.col("role").alias("source_note"), F.col("text").alias("content"), F.lit(None).cast("string").alias("tags"))
    out = search.with_annotations(d.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), notes)
    return out.select(F.col("id").alias("doc_id"), F.md5("content").alias("content_md5"))


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'N') OR l_linenumber = 3 AS needles, l_returnflag = 'R' AS classics, l_linenumber = 2 OR l_linestatus = 'F' AS notes, true AS every FROM lineitem
""")
def allowed_results(spark, sf_dir):
    """The page's filters over results of each type."""
    r = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "acupuncture").when(F.col("l_returnflag") == "N", "meridian").otherwise("theory")
    rows = r.select("l_orderkey", "l_linenumber", kind.alias("type"), F.when(F.col("l_linenumber") == 3, "穴位").otherwise("x").alias("group_name"), (F.col("l_linenumber") == 2).alias("has_annotations"), F.when(F.col("l_linestatus") == "F", "fts,annotation").otherwise("fts").alias("matched_by"))
    return rows.select("l_orderkey", "l_linenumber", *(search.allows(n).alias(a) for n, a in (("针灸", "needles"), ("原典", "classics"), ("注解", "notes"), ("别的", "every"))))


@query("""
SELECT doc_id AS item_id, 'normalized' AS term_type, unnest(CASE doc_id % 3 WHEN 0 THEN ['足三里', 'st36'] WHEN 1 THEN ['黄芪'] ELSE [] END) AS term, unnest(CASE doc_id % 3 WHEN 0 THEN [110, 110] WHEN 1 THEN [100] ELSE [] END)::INT AS weight FROM documents
UNION ALL SELECT doc_id, 'detail', unnest([n_chars::VARCHAR, lower(source)]), 35 FROM documents UNION ALL SELECT doc_id, 'detail', n_chars::VARCHAR || lower(source), 30 FROM documents
""")
def known_terms(spark, sf_dir):
    """Terms of items whose code and detail name known points and herbs; details are JSON."""
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 3 == 0, "足三里ＳＴ36").when(F.col("doc_id") % 3 == 1, "黄 芪")
    items = d.select(F.col("doc_id").alias("id"), code.alias("code"), F.to_json(F.struct(F.col("n_chars").alias("a"), F.array("source").alias("b"))).alias("detail"))
    return search.build_terms(items).where("term_type in ('normalized', 'detail')")


@query("""
WITH f AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0), t AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)
SELECT user_id AS item_id FROM ((SELECT * FROM f EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM f))
""")
def favorites_toggled(spark, sf_dir):
    """Favorites of which some are taken away and others added."""
    e = table(spark, sf_dir, "events")
    ids = (lambda k: e.where(F.col("user_id") % k == 0).select(F.col("user_id").alias("item_id")).distinct())
    return history.toggle(ids(2), ids(3))


# texts


@query("""
SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN source || '传统作用：补气。' WHEN 1 THEN source || '。甘草' ELSE source || '，请看。' END) AS kept FROM documents
""")
def reminders_removed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat("source", F.lit("传统作用学习参考：补气。仅供学习参考用。"))).when(k == 1, F.concat("source", F.lit(" 。。请勿服用。甘草"))).otherwise(F.concat("source", F.lit(" ，请看。不作为依据。")))
    return d.select("doc_id", F.md5(curate.without_reminders(text)).alias("kept"))


@query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '（ST' || s_suppkey || '）为胃经第' || s_suppkey || '穴。' ELSE s_name || '（X）属胃经。' END AS text FROM supplier
""")
def point_descriptions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    code = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ST"), "s_suppkey")).otherwise("X")
    return s.select(F.col("s_suppkey").alias("id"), curate.point_description("s_name", code, F.lit("胃经")).alias("text"))


@query("""
SELECT event_id, event_type || '，' || user_id AS listed, coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN event_type ELSE ' ' END), ''), 'p' || user_id) AS asked,
  strftime(ts, '%Y%m%d%H%M%S') AS stamp, (epoch_us(ts) // 1000)::BIGINT AS millis, (2.0 * len(list_filter(string_split(event_type, ''), lambda c: contains('purchase', c))) / (length(event_type) + 8))::DOUBLE AS overlap, round(jaro_similarity(event_type, 'purchases'), 6) AS jaro FROM events
""")
def small_functions(spark, sf_dir):
    """Joined lists, the question of a message, time stamps and string similarities over a table's rows."""
    e = table(spark, sf_dir, "events")
    message = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" ").alias("question"), F.concat(F.lit("p"), "user_id").alias("prompt")))
    stamp, millis = history.time_stamps("ts")
    return e.select(
        "event_id", T.unique_join("event_type", F.col("user_id").cast("string"), "event_type").alias("listed"), V.question_of(message).alias("asked"), stamp.alias("stamp"), millis.alias("millis"),
        T.overlap_similarity("event_type", F.lit("purchase")).alias("overlap"), F.round(udfs.jaro("event_type", F.lit("purchases")), 6).alias("jaro"),
    )


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END::INT AS n, role AS first FROM conversations
""")
def source_lists(spark, sf_dir):
    """Sources without repeats and blanks."""
    c = table(spark, sf_dir, "conversations")

    def source(title, note):
        return F.struct(title.alias("title"), note.alias("note"))

    none = F.lit(None).cast("string")
    every = F.array(source(F.lit(" "), none), source(F.col("role"), F.lit("n")), source(F.concat(F.lit(" "), "role"), F.lit("n ")), source(F.col("role"), F.when(F.col("turn") % 2 == 0, "m").otherwise("n")))
    told = history.distinct_sources(every)
    return c.select("conv_id", "turn", F.size(told).alias("n"), told[0]["title"].alias("first"))


@query("""
SELECT doc_id, 'T &' || source || '<' AS title, 'http://x/' || doc_id AS url, CASE WHEN length(lang || ' text') > 0 THEN lang || ' text' END AS snippet, 2 AS n FROM documents
""")
def result_cards(spark, sf_dir):
    """Cards of result pages that carry each document's source and language."""
    d = table(spark, sf_dir, "documents")
    page = F.concat(
        F.lit('<li class="b_algo"><h2><a href="http://x/'), "doc_id", F.lit('">T &amp;<b>'), "source", F.lit("</b>&lt;</a></h2><p class=s>"), "lang", F.lit(' text</p></li>'),
        F.lit('<li class="b_algo"><a href="http://x/'), "doc_id", F.lit('">again</a></li><li class="b_algo"><a href="/local">local</a></li><li class="b_algo"><a href="https://y/">other</a></li>'),
    )
    told = d.select("doc_id", udfs.cards(page).alias("c"))
    first = F.get("c", F.lit(0))
    return told.select("doc_id", first["title"].alias("title"), first["url"].alias("url"), first["snippet"].alias("snippet"), F.size("c").alias("n"))


# files and stores


@query("SELECT c_custkey AS id, c_name || '，\"x\"' AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
def files_read_back(spark, sf_dir):
    """Rows written as CSV and as JSON lines, and read back."""
    root = store.shared_folder(spark, "files")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    store.export_csv(c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit('，"x"')).alias("name"), F.col("c_mktsegment").alias("segment")), f"{root}/csv")
    store.export_json(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), f"{root}/json")
    a = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(f"{root}/csv")
    b = spark.read.schema("id long, name string").json(f"{root}/json").withColumn("segment", F.lit(None).cast("string"))
    return a.select(F.col("id").cast("long").alias("id"), "name", "segment").unionByName(b)


@query("""
SELECT 'now' AS state, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 2 = 0
UNION ALL SELECT 'restored', count(*) FROM customer UNION ALL SELECT 'cleared', 0 UNION ALL SELECT 'template', 1 UNION ALL SELECT 'recent', least(count(*), 10000) FROM events
""")
def store_states(spark, sf_dir):
    """A store's tables after a delete with cascade, a backup restored, a table cleared, a template and a log exported."""
    root = store.shared_folder(spark, "store")
    s = store.Store(spark, f"{root}/now")
    c, o = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "item_id")
    s.write("customer", c)
    s.write("orders", o)
    s.backup(["customer"], f"{root}/backup")
    s.delete("customer", c.where("id % 2 = 1").select("id"), children={"orders": "item_id"})
    other = store.Store(spark, f"{root}/other")
    other.restore(["customer"], f"{root}/backup")
    other.write("orders", o)
    other.clear(["orders"])
    imports.save_template(s, 7, {"甲": "name"})
    imports.save_template(s, 7, {"乙": "name"})
    store.export_recent(table(spark, sf_dir, "events").withColumnRenamed("event_id", "id"), f"{root}/log")
    states = {"now": s.read("customer"), "orders": s.read("orders"), "restored": other.read("customer"), "cleared": other.read("orders"), "template": s.read("mapping_templates").where(F.element_at("mapping", "乙") == "name"), "recent": spark.read.json(f"{root}/log")}
    out = None
    for name, df in states.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n")
        out = one if out is None else out.unionByName(one)
    return out
