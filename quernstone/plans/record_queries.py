"""Profiles, integrity, history, logs and mutations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import values as V
from quernstone.operators import history, profile, store
from quernstone.plans.registry import query, table

NOW = "2024-01-31 00:00:00"  # the logs' carrier ends here


@query("""
SELECT event_type AS error_type, count(*)::BIGINT AS n, (count(*) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00'))::BIGINT AS n_day FROM events
WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1 ORDER BY n DESC, error_type LIMIT 10
""")
def error_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("error_type"), "ts")
    return profile.error_statistics(e, NOW)


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00'")
def log_retention(spark, sf_dir):
    return profile.retained(table(spark, sf_dir, "events"), NOW, 20).select("event_id", "user_id")


@query("""
WITH c AS (
 SELECT 'orphan_lines' AS check_name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
 UNION ALL SELECT 'orphan_orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
 UNION ALL SELECT 'missing_names', count(*) FROM part WHERE nullif(p_name, 'red widget') IS NULL
 UNION ALL SELECT 'repeated_names', count(*) FROM (SELECT p_type, p_name FROM part GROUP BY 1, 2 HAVING count(*) > 1))
SELECT check_name, n::BIGINT AS n FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c
""")
def integrity(spark, sf_dir):
    r, o, c, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    return profile.integrity({
        "orphan_lines": profile.orphans(r, "l_orderkey", o.where("o_orderstatus != 'P'"), "o_orderkey"),
        "orphan_orders": profile.orphans(o, "o_custkey", c.where("c_acctbal > 0"), "c_custkey"),
        "missing_names": p.where(F.expr("nullif(p_name, 'red widget') is null")),
        "repeated_names": profile.repeated(p, ["p_type", "p_name"]),
    })


@query("""
SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error')::INT DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return store.latest(e, ["user_id"], [F.desc(F.col("event_type") == "error"), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version_no FROM events
""")
def version_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return history.number_versions(e, "user_id", "ts", "event_id").select("user_id", "event_id", "version_no")


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, NULL AS note FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 5 = 0 THEN 'n' END AS note FROM orders)
SELECT o_orderkey, 'status' AS field, a.status AS old_value, b.status AS new_value FROM a JOIN b USING (o_orderkey) WHERE a.status <> b.status
UNION ALL SELECT o_orderkey, 'note', NULL, b.note FROM b WHERE note IS NOT NULL
""")
def version_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))
    a = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    b = F.to_json(F.struct(status.alias("status"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 5 == 0, "n").alias("note")))
    return o.select("o_orderkey", F.inline(history.version_diff(b, a)))


@query("""
SELECT user_id AS item_id, max(ts) AS viewed_at FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50
""")
def recent_views(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("item_id"), F.col("ts").alias("viewed_at"))
    return history.recent(e, 80)


@query("""
WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), t AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id AS item_id FROM ((SELECT * FROM f EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM f))
""")
def favorites(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ids = (lambda k: e.where(F.col("event_type") == k).select(F.col("user_id").alias("item_id")).distinct())
    return history.toggle(ids("click"), ids("purchase"))


@query("""
WITH n AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS c_mktsegment FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n
""")
def upsert(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders")
    new = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return store.upserted(c, new, ["c_custkey"])


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
def cascade_delete(spark, sf_dir):
    r, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    gone = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return r.join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""
SELECT c_custkey || ',"' || c_mktsegment || ', ""' || c_name || '""' || '"' || ',' || c_nationkey AS line FROM customer
""")
def export_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    quoted = F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"'))
    return store.csv_lines(c.select(F.col("c_custkey").alias("a"), quoted.alias("b"), F.col("c_nationkey").alias("c")))


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN array_to_string(list_sort(list_distinct([p_type, p_brand, 'neu'])), '，') ELSE p_type || ',' || p_brand END AS tags, CASE WHEN p_size > 25 THEN 'archived' ELSE 'ready' END AS data_status FROM part
""")
def batch_update(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(","), "p_brand").alias("tags"), F.lit("ready").alias("data_status"))
    ids = p.where("p_size > 25").select(F.col("p_partkey").alias("id"))
    out = store.set_status(store.add_tags(items, ids, "neu"), ids, "archived")
    return out.select(F.col("id").alias("p_partkey"), "tags", "data_status")


@query("""
SELECT lang AS value, count(*)::BIGINT AS n FROM (SELECT CASE lang WHEN 'es' THEN '未填写' ELSE lang END AS lang FROM documents) GROUP BY 1
""")
def histogram(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("nullif(lang, 'es')").alias("lang"))
    return profile.histogram(d, "lang")


@query("""
SELECT 'toxic' AS field, (SELECT count(*) FROM documents)::BIGINT AS n_rows, (SELECT count(*) FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE l.doc_id IS NULL)::BIGINT AS n_missing, 0::BIGINT AS n_blank
UNION ALL SELECT 'source', count(*), 0, count(*) FILTER (source = 'src1') FROM documents
""")
def column_profile(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = d.join(l, "doc_id", "left").select("toxic", F.when(F.col("source") == "src1", " ").otherwise(F.col("source")).alias("source"))
    return profile.column_profile(rows, ["toxic", "source"])


@query("""
SELECT k AS keyword, coalesce(bool_or(contains(text, k)), false) AS present FROM documents, (SELECT unnest(['idiot', 'Apache License', 'no such words here']) AS k) GROUP BY 1
""")
def keyword_presence(spark, sf_dir):
    return profile.keyword_presence(table(spark, sf_dir, "documents"), "text", ["idiot", "Apache License", "no such words here"])


@query("""
SELECT doc_id, n_chars, (SELECT count(*) FROM conversations WHERE conv_id = doc_id)::INT AS n_notes, (SELECT max(turn) FROM conversations WHERE conv_id = doc_id) AS last_turn FROM documents
""")
def detail_bundle(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), "turn", "role")
    out = history.bundle(d.select("id", "n_chars"), {"notes": (notes, ["turn"])})
    last = F.try_element_at("notes", F.lit(-1))["turn"]
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.coalesce(F.size("notes"), F.lit(0)).alias("n_notes"), last.alias("last_turn")).withColumn("n_notes", F.when(F.col("n_notes") < 0, 0).otherwise(F.col("n_notes")))


@query("""
WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id AS job_id, CASE WHEN count(*) >= 2 THEN 'success' ELSE 'running' END AS status FROM s GROUP BY 1
""")
def job_lifecycle(spark, sf_dir):
    """Each user's first event starts a job, the second ends it; whatever follows doesn't count."""
    e = history.number_versions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    status = F.when(F.col("version_no") == 1, "running").when(F.col("version_no") == 2, "success").otherwise("running")
    jobs = e.select(F.col("user_id").alias("job_id"), F.col("version_no").alias("seq"), status.alias("status"), F.lit(50.0).alias("progress"))
    return history.job_states(jobs).select("job_id", "status")


@query("""
SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def windowed_counts(spark, sf_dir):
    """The batch form of the stream's tumbling windows."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour THEN 1 ELSE 0 END AS new_ FROM events),
s AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, sid
""")
def user_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS name, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS second FROM documents
""")
def detail_overlay(spark, sf_dir):
    """Two detail objects laid over each other, the main one's keys first."""
    d = table(spark, sf_dir, "documents")
    main = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("name"), F.col("source"), F.lit("second"), F.col("lang"))).otherwise(F.create_map(F.lit("name"), F.col("lang")))
    both = V.overlay(main, F.create_map(F.lit("name"), F.lit("x"), F.lit("second"), F.col("source")))
    return d.select("doc_id", F.element_at(both, "name").alias("name"), F.element_at(both, "second").alias("second"))
