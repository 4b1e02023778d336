"""Retrieval: terms, postings, BM25, fusion, enhanced search, listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import search
from quernstone.plans.carriers import part_index, part_items, table, text_index
from quernstone.plans.registry import query

TERMS_SQL = r"""
  SELECT p_partkey AS item_id, 'name' AS term_type, replace(lower(p_name), ' ', '') AS term, 100 AS weight FROM part
  UNION ALL SELECT p_partkey, 'code', 'p' || p_partkey, 95 FROM part
  UNION ALL SELECT p_partkey, 'category', lower(p_type), 55 FROM part
  UNION ALL SELECT DISTINCT p_partkey, 'alias', unnest(string_split(lower(p_name), ' ')), 85 FROM part
  UNION ALL SELECT p_partkey, 'alias', replace(lower(p_name), ' ', ''), 80 FROM part WHERE p_name LIKE '% %'
  UNION ALL SELECT p_partkey, 'tags', lower(p_brand), 45 FROM part
"""
SCORES_SQL = """
  SELECT item_id, max(weight + CASE WHEN term = '{q}' THEN 120 WHEN term ILIKE '{q}%' THEN 70 ELSE 25 END) AS score,
         array_to_string(list_sort(list(DISTINCT term_type)), ',') AS matched_by FROM terms WHERE term ILIKE '%{q}%' GROUP BY item_id
"""


@query("SELECT item_id, term_type, term, weight::INT AS weight FROM (" + TERMS_SQL + ") WHERE term <> ''")
def build_terms(spark, sf_dir):
    return search.build_terms(part_items(spark, sf_dir), detail_is_json=False)


@query("WITH terms AS (" + TERMS_SQL + "), s AS (" + SCORES_SQL.format(q="ring") + """)
SELECT item_id, score::INT AS score, matched_by, p_name AS name FROM s JOIN part ON item_id = p_partkey WHERE p_brand <> 'Brand#2' ORDER BY score DESC, item_id LIMIT 100""")
def term_search(spark, sf_dir):
    items = part_items(spark, sf_dir)
    status = F.when(F.col("tags") == "Brand#2", "draft").otherwise("ready")
    listing = items.select(F.col("id").alias("item_id"), "type", "name", status.alias("data_status"))
    return part_index(spark, sf_dir).term_search("ring", listing=listing).select("item_id", "score", "matched_by", "name")


BM_TEMPLATE = r"""
  tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda t: t <> '') AS toks FROM documents),
  cnt AS (SELECT doc_id, {f} AS f, len(toks) AS dl FROM tok),
  whole AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f > 0) AS k FROM cnt),
  bm AS (SELECT doc_id, -(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm25 FROM cnt, whole WHERE f > 0)
"""


def bm_sql(f: str) -> str:
    """The closed form as table expressions, ``f`` counting the hits in ``toks``."""
    return BM_TEMPLATE.replace("{f}", f)


PREFIX = "len(list_filter(toks, lambda t: starts_with(t, '{q}')))"


@query("WITH " + bm_sql(PREFIX.format(q="path")) + "SELECT doc_id, round(bm25, 6) AS bm25, (40 - trunc(bm25))::INT AS score FROM bm")
def bm25_prefix(spark, sf_dir):
    return text_index(spark, sf_dir).bm25("path").select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), search.text_score(F.col("bm25")).alias("score"))


@query("WITH " + bm_sql("len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'license' AND toks[i + 1] = 'version'))") + "SELECT doc_id, round(bm25, 6) AS bm25, (40 - trunc(bm25))::INT AS score FROM bm")
def bm25_phrase(spark, sf_dir):
    return text_index(spark, sf_dir).bm25("license version").select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), search.text_score(F.col("bm25")).alias("score"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda t: t <> '') AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS tok FROM t)
SELECT tok, count(*)::BIGINT AS tf, count(DISTINCT doc_id)::BIGINT AS df FROM e GROUP BY tok
""")
def posting_statistics(spark, sf_dir):
    """Frequencies of every token: the vocabulary of the stored full-text index."""
    rows = text_index(spark, sf_dir).live("postings")
    return rows.groupBy(F.col("token").alias("tok")).agg(F.sum(F.size("places")).alias("tf"), F.count("*").alias("df"))


@query("WITH terms AS (" + TERMS_SQL + "), s AS (" + SCORES_SQL.format(q="blue") + r"""),
tok AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '') || list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM part),
cnt AS (SELECT p_partkey, len(list_filter(toks, lambda t: starts_with(t, 'blue'))) AS f, len(toks) AS dl FROM tok),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f > 0) AS k FROM cnt),
x AS (SELECT p_partkey AS item_id, 40 - trunc(-(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM cnt, whole WHERE f > 0),
topt AS (SELECT * FROM s ORDER BY score DESC, item_id LIMIT 500), topx AS (SELECT * FROM x ORDER BY score DESC, item_id LIMIT 500)
SELECT coalesce(topt.item_id, topx.item_id) AS item_id, (coalesce(topt.score, 0) + coalesce(topx.score, 0))::BIGINT AS score,
  CASE WHEN topx.item_id IS NULL THEN matched_by WHEN topt.item_id IS NULL THEN 'fts' ELSE matched_by || ',fts' END AS matched_by
FROM topt FULL JOIN topx ON topt.item_id = topx.item_id ORDER BY 2 DESC, 1 LIMIT 500
""")
def fused_search(spark, sf_dir):
    index = part_index(spark, sf_dir)
    k = search.candidate_limit(10, 50)
    terms = search.term_scores(index.hits("blue"), "blue").orderBy(F.desc("score"), "item_id").limit(k)
    text = index.bm25("blue").select(F.col("id").alias("item_id"), search.text_score(F.col("bm25")).alias("score"), F.lit("fts").alias("matched_by"))
    return search.fuse([("term", terms), ("fts", text.orderBy(F.desc("score"), "item_id").limit(k))], k)


@query("WITH " + bm_sql(PREFIX.format(q="clown")) + r""",
basic AS (SELECT doc_id AS item_id, (40 - trunc(bm25))::BIGINT AS score, 'fts' AS matched_by FROM bm ORDER BY 2 DESC, 1 LIMIT 200),
noted AS (SELECT DISTINCT conv_id AS item_id FROM conversations WHERE text ILIKE '%clown%' ORDER BY 1 LIMIT 200),
hits AS (SELECT * FROM basic UNION ALL SELECT item_id, 65, 'annotation' FROM noted WHERE item_id NOT IN (SELECT item_id FROM basic)),
ann AS (SELECT conv_id, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY contains(text, 'clown')::INT DESC, turn DESC) AS rn FROM conversations)
SELECT item_id, score, matched_by, source AS name, CASE lang WHEN 'en' THEN CASE WHEN source LIKE '%1%' THEN '经络' ELSE '穴位' END WHEN 'de' THEN '方剂' ELSE '其他' END AS group_name,
  coalesce(n, 0)::BIGINT AS n_annotations,
  CASE WHEN strpos(d.text, 'clown') > 0 THEN CASE WHEN length(substring(d.text, greatest(strpos(d.text, 'clown') - 29, 1), strpos(d.text, 'clown') + 95 - greatest(strpos(d.text, 'clown') - 29, 1))) > 140 THEN 'x' ELSE substring(d.text, greatest(strpos(d.text, 'clown') - 29, 1), strpos(d.text, 'clown') + 95 - greatest(strpos(d.text, 'clown') - 29, 1)) END
       WHEN length(d.text) > 120 THEN substring(d.text, 1, 120) || '...' ELSE d.text END AS snippet,
  CASE WHEN strpos(ann.text, 'clown') > 0 THEN substring(ann.text, greatest(strpos(ann.text, 'clown') - 29, 1), strpos(ann.text, 'clown') + 95 - greatest(strpos(ann.text, 'clown') - 29, 1)) END AS annotation_snippet
FROM hits JOIN documents d ON item_id = doc_id LEFT JOIN ann ON conv_id = item_id AND rn = 1
""")
def enhanced_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "acupuncture").when(F.col("lang") == "de", "formula").otherwise("other")
    category = F.when(F.contains("source", F.lit("1")), "胃经").otherwise("穴")
    none = F.lit(None).cast("string")
    items = d.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), kind.alias("type"), category.alias("category"), F.col("text").alias("content"), none.alias("summary"), none.alias("detail"))
    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), F.col("text").alias("content"))
    hits = text_index(spark, sf_dir).bm25("clown").select(F.col("id").alias("item_id"), search.text_score(F.col("bm25")).cast("long").alias("score"), F.lit("fts").alias("matched_by"))
    return search.enhanced(hits.orderBy(F.desc("score"), "item_id").limit(200), items, notes, "clown")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority ILIKE '%high%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100
""")
def list_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & search.contains_ci("o_orderpriority", "high"))
    return search.page(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '中药' WHEN 'N' THEN '方剂' ELSE '其他' END AS group_name,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 8 END::INT AS place FROM lineitem
""")
def grouped_results(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "herb").when(F.col("l_returnflag") == "N", "formula").otherwise("x")
    g = search.group_name(kind)
    return r.select("l_orderkey", "l_linenumber", g.alias("group_name"), search.group_order(g).alias("place"))


@query("""
WITH q(term) AS (SELECT unnest(['idiot', 'pathetic', 'clown', 'worthless'])),
hits AS (SELECT term, doc_id, len(string_split(lower(text), term)) - 1 AS n FROM q JOIN documents ON contains(lower(text), term))
SELECT term, doc_id, n::INT AS n FROM hits
""")
def context_terms(spark, sf_dir):
    """Documents by each of a few query terms, in one pass over the texts."""
    d = table(spark, sf_dir, "documents")
    low = F.lower("text")
    words = ["idiot", "pathetic", "clown", "worthless"]
    counts = F.array(*(F.struct(F.lit(w).alias("term"), (F.size(F.split(low, w)) - 1).alias("n")) for w in words))
    return d.select("doc_id", F.inline(F.filter(counts, lambda c: c["n"] > 0)))


@query("""
WITH r AS (SELECT doc_id, source, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM documents)
SELECT doc_id, source, coalesce(used, 0)::BIGINT AS used, least(n, 20000 - coalesce(used, 0))::BIGINT AS room FROM r WHERE coalesce(used, 0) < 20000
""")
def char_budget(spark, sf_dir):
    from quernstone.operators.history import budget

    d = table(spark, sf_dir, "documents")
    out = budget(d, "source", ["doc_id"], F.length("text"), 20000)
    return out.select("doc_id", "source", F.col("used").cast("long").alias("used"), F.col("room").cast("long").alias("room"))


@query("""
SELECT lower(event_type) AS term, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, term LIMIT 3
""")
def hot_terms(spark, sf_dir):
    from quernstone.operators.profile import top_values

    e = table(spark, sf_dir, "events").select(F.lower("event_type").alias("term"))
    return top_values(e, "term", 3)


@query("""
WITH e AS (SELECT *, md5(text) AS h FROM documents)
SELECT doc_id, source, n_chars FROM e WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
SELECT d.doc_id, 'label-' || max(quality), max(n_chars) FROM documents d JOIN labels USING (doc_id) GROUP BY d.doc_id
""")
def incremental_index(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    per = l.groupBy("doc_id").agg(F.max("quality").alias("q"))
    changed = d.join(per, "doc_id").groupBy("doc_id").agg(F.concat(F.lit("label-"), F.max("q")).alias("source"), F.max("n_chars").alias("n_chars"))
    return search.reindex(d.select("doc_id", "source", "n_chars"), changed, key="doc_id")


@query("""
SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src3' AND (text ILIKE '%clown%' OR source ILIKE '%clown%')
""")
def filtered_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.select("doc_id", F.col("lang").alias("type"), F.when(F.col("source") == "src3", "draft").otherwise("ready").alias("data_status"), "text", "source")
    return items.where(search.item_filter(item_type="en", status="ready", text="clown", columns=["text", "source"])).select("doc_id")


@query("WITH terms AS (" + TERMS_SQL + """), q AS (SELECT unnest(['red', 'P17', 'Brand#4', 'nothing here']) AS query),
h AS (SELECT query, item_id, max(weight + CASE WHEN term = lower(query) THEN 120 WHEN starts_with(term, lower(query)) THEN 70 ELSE 25 END) AS score FROM q JOIN terms ON contains(term, replace(lower(query), ' ', '')) GROUP BY 1, 2)
SELECT query, item_id, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS rn FROM h) WHERE rn = 1
""")
def search_probe(spark, sf_dir):
    items = part_items(spark, sf_dir)
    listing = items.select(F.col("id").alias("item_id"), "data_status")
    return search.probe(part_index(spark, sf_dir).live("terms"), listing, ["red", "P17", "Brand#4", "nothing here"])


ITEMS_SQL = "items AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'formula' WHEN 'de' THEN 'acupoint' ELSE 'herb' END AS type, source AS name, text AS content FROM documents)"


def document_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "formula").when(F.col("lang") == "de", "acupoint").otherwise("herb")
    none = F.lit(None).cast("string")
    rest = ["alias", "category", "summary", "source_note", "tags", "detail"]
    return d.select(F.col("doc_id").alias("id"), kind.alias("type"), F.col("source").alias("name"), F.col("text").alias("content"), *(none.alias(c) for c in rest))


@query("WITH " + ITEMS_SQL + """, t AS (SELECT unnest(['clown方', 'idiot', 'clown']) AS term, unnest([0, 1, 2]) AS seq),
h AS (SELECT id, type, min(seq) AS seq FROM items JOIN t ON contains(lower(content), term) WHERE type <> 'acupoint' GROUP BY 1, 2)
SELECT id, (seq::INT) AS seq FROM h ORDER BY (type = 'formula') DESC, seq, id LIMIT 24
""")
def rag_context(spark, sf_dir):
    """The items that go into the context of a question: formulas first, then by the first term that they match."""
    from quernstone.operators import answers

    return answers.context_items(document_items(spark, sf_dir), "idiot，clown方", max_items=8).select("id", "seq")


@query("WITH " + ITEMS_SQL + """,
notes AS (SELECT conv_id AS id, text FROM conversations WHERE text ILIKE '%pathetic%'),
s AS (SELECT id, 90 AS score FROM items WHERE type = 'formula' AND content ILIKE '%pathetic%'
  UNION ALL SELECT n.id, 90 FROM notes n JOIN items i ON i.id = n.id WHERE i.type = 'formula'
  UNION ALL SELECT 7, 200 FROM items WHERE id = 7 AND type = 'formula')
SELECT id AS item_id, sum(score)::BIGINT AS score FROM s GROUP BY 1
""")
def formula_candidates(spark, sf_dir):
    from quernstone.operators import answers

    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("text").alias("content"))
    return answers.formula_scores(document_items(spark, sf_dir), notes, "pathetic", related_id=7)
