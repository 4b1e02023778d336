"""Queries over stored tables that change: index segments, touched buckets, appends, tombstones."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import resolve, search
from quernstone.operators import store as st
from quernstone.operators.index import SearchIndex
from quernstone.plans.carriers import part_items, table, text_items
from quernstone.plans.registry import query
from quernstone.plans.search_queries import PREFIX, SCORES_SQL, TERMS_SQL, bm_sql
from quernstone.sources import csvscan, records

CHANGED_DOCUMENTS = "documents AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text || ' path license version' ELSE text END AS text FROM main.documents WHERE doc_id % 11 <> 5)"


def changed_index(spark, sf_dir):
    """An index of the documents after some were changed, some removed, and some added late."""
    items = text_items(spark, sf_dir)
    late, k = F.col("id") % 13 == 1, F.col("id")
    index = SearchIndex(st.Store(spark, st.shared_folder(spark, "changed")), ["content"], detail_is_json=False)
    index.build(items.where(~late))
    index.apply(items.where(late))
    index.apply(items.where((k % 7 == 3) & (k % 11 != 5)).withColumn("content", F.concat("content", F.lit(" path license version"))), items.where(k % 11 == 5).select("id"))
    return index


def scored(hits):
    return hits.select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {CHANGED_DOCUMENTS}, " + bm_sql(PREFIX.format(q="path")) + "SELECT doc_id, round(bm25, 6) AS bm25 FROM bm")
def segmented_prefix(spark, sf_dir):
    """BM25 over three segments and their tombstones: as over a fresh index."""
    return scored(changed_index(spark, sf_dir).bm25("path"))


@query(f"WITH {CHANGED_DOCUMENTS}, " + bm_sql("len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'license' AND toks[i + 1] = 'version'))") + "SELECT doc_id, round(bm25, 6) AS bm25 FROM bm")
def compacted_phrase(spark, sf_dir):
    """The same after compaction into one segment."""
    index = changed_index(spark, sf_dir)
    index.compact()
    return scored(index.bm25("license version"))


CHANGED_PARTS = "part AS (SELECT * REPLACE (CASE WHEN p_partkey % 5 = 2 THEN 'blue spring ' || p_partkey ELSE p_name END AS p_name) FROM main.part WHERE p_partkey % 9 <> 4)"


@query(f"WITH {CHANGED_PARTS}, terms AS (" + TERMS_SQL + "), s AS (" + SCORES_SQL.format(q="prin") + """)
SELECT item_id, score::INT AS score, matched_by, p_name AS name FROM s JOIN part ON item_id = p_partkey ORDER BY score DESC, item_id LIMIT 100""")
def segmented_terms(spark, sf_dir):
    """Substring search by grams over segments: changed items answer by their new terms, removed ones not at all."""
    items, k = part_items(spark, sf_dir), F.col("id")
    index = SearchIndex(st.Store(spark, st.shared_folder(spark, "parts")), ["name"], detail_is_json=False)
    index.build(items)
    renamed = items.where((k % 5 == 2) & (k % 9 != 4)).withColumns({c: F.concat(F.lit("blue spring "), "id") for c in ("name", "alias")})
    index.apply(renamed, items.where(k % 9 == 4).select("id"))
    return index.term_search("prin").select("item_id", "score", "matched_by", "name")


@query("""
SELECT word, count(*)::BIGINT AS n_terms FROM (SELECT DISTINCT unnest(['a', 'rin', 'Lue', 'p1', '%ing%e', 'MEDIUM B', 'zzz', 'r_d']) AS word), (SELECT DISTINCT term FROM (""" + TERMS_SQL + """) WHERE term <> '') WHERE term ILIKE '%' || word || '%' GROUP BY 1
""")
def gram_matches(spark, sf_dir):
    """Distinct terms that hold each query, by its rarest gram: short queries, capitals and wildcards among them."""
    from quernstone.plans.carriers import part_index

    index, out = part_index(spark, sf_dir), None
    for word in ["a", "rin", "Lue", "p1", "%ing%e", "MEDIUM B", "zzz", "r_d"]:
        found = index.matching_terms(word).select(F.lit(word).alias("word"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("word").agg(F.count("*").alias("n_terms"))


@query("""
WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM customer), u AS (SELECT c_custkey, 'new ' || c_name AS c_name, c_acctbal FROM c WHERE c_custkey % 10 = 3 UNION ALL SELECT -c_custkey, c_name, 0 FROM c WHERE c_custkey % 10 = 4)
SELECT * FROM u UNION ALL SELECT * FROM c WHERE c_custkey % 10 NOT IN (3, 5)
""")
def bucketed_table(spark, sf_dir):
    """A table with keys after an upsert of old and new keys and a delete."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey") % 10
    s = st.Store(spark, st.shared_folder(spark, "buckets"))
    s.write("customers", c, keys=["c_custkey"])
    new = c.where(k == 3).withColumn("c_name", F.concat(F.lit("new "), "c_name")).unionByName(c.where(k == 4).select((-F.col("c_custkey")).alias("c_custkey"), "c_name", F.lit(0).cast("double").alias("c_acctbal")))
    s.upsert("customers", new, ["c_custkey"])
    s.delete("customers", c.where(k == 5).select("c_custkey"), "c_custkey")
    return s.read("customers")


@query("""
SELECT 'buckets rewritten' AS what, 1::BIGINT AS n UNION ALL SELECT 'folders added by append', 1 UNION ALL SELECT 'folders kept by append', count(*) FROM (SELECT 1 FROM nation LIMIT 1)
UNION ALL SELECT 'rows', (SELECT count(*) FROM orders) + (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 7) UNION ALL SELECT 'versions after vacuum', 1
""")
def touched_folders(spark, sf_dir):
    """What mutations write, by the manifests: an upsert of one key one bucket, an append one folder."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    s = st.Store(spark, st.shared_folder(spark, "touched"))
    s.write("orders", o, keys=["o_orderkey"])
    before = {f["path"] for f in s.manifest("orders")["folders"]}
    s.upsert("orders", o.orderBy("o_orderkey").limit(1), ["o_orderkey"])
    after = {f["path"] for f in s.manifest("orders")["folders"]}
    s.write("log", o)
    first = {f["path"] for f in s.manifest("log")["folders"]}
    s.append("log", o.where("o_orderkey % 100 = 7"))
    second = {f["path"] for f in s.manifest("log")["folders"]}
    s.vacuum("log")
    told = [("buckets rewritten", len(after - before)), ("folders added by append", len(second - first)), ("folders kept by append", len(first & second)), ("rows", s.read("log").count()), ("versions after vacuum", len(s.versions("log")))]
    return spark.createDataFrame(told, "what string, n long")


@query("""
SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_nationkey + 10 <= (SELECT max(n_nationkey) FROM nation) THEN c_nationkey + 10 END ELSE c_nationkey END AS item_id FROM customer
WHERE c_custkey % 3 <> 0 OR c_nationkey + 10 <= (SELECT max(n_nationkey) FROM nation)
""")
def absent_references(spark, sf_dir):
    """A reference whose id names no item meets none, whatever its name."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    given = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 10).cast("long")
    refs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ref_id"), given.alias("item_id"), F.lit(None).cast("string").alias("code"), F.col("n_name").alias("name"))
    items = n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return resolve.resolve_reference(refs, items)


@query(r"""
WITH d AS (SELECT doc_id, source || '_' || lang AS text FROM documents), q AS (SELECT min(source) || '_' || min(lang) AS q FROM documents)
SELECT doc_id FROM d, q WHERE array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda t: t <> ''), ' ') = array_to_string(list_filter(string_split_regex(lower(q), '[^\p{L}\p{N}\p{M}]+'), lambda t: t <> ''), ' ')
""")
def underscored_words(spark, sf_dir):
    """A query is cut into words by the rule of the index: an underscore parts words, and a query of marks alone finds nothing."""
    d = table(spark, sf_dir, "documents")
    told = d.select(F.col("doc_id").alias("id"), F.concat_ws("_", "source", "lang").alias("content"))
    low = d.agg(F.min("source"), F.min("lang")).first()
    hits = search.bm25(told, ["content"], "_".join(low)).unionByName(search.bm25(told, ["content"], "..."))
    return hits.select(F.col("id").alias("doc_id"))


@query(r"""
SELECT c_custkey::VARCHAR AS key, 'he said "' || c_name || '",' || chr(10) || c_mktsegment AS told, coalesce(c_address, '') AS address FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'a "quote" ' || c_nationkey END AS c_address FROM customer)
""")
def csv_read_back(spark, sf_dir):
    """CSV files with quotes, commas and line ends in their cells, read by the parallel scan."""
    c = table(spark, sf_dir, "customer")
    told = F.concat(F.lit('he said "'), "c_name", F.lit('",\n'), "c_mktsegment")
    address = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('a "quote" '), "c_nationkey"))
    root = st.shared_folder(spark, "csv")
    st.export_csv(c.select(F.col("c_custkey").alias("key"), told.alias("told"), address.alias("address")), root)
    rows = csvscan.csv_rows(spark, root)
    return rows.select(*(F.try_element_at("record", F.lit(k)).alias(k) for k in ("key", "told", "address")))


@query("""
SELECT s_suppkey::VARCHAR AS code, s_name AS name, 'herb' AS type, 'w' || s_nationkey AS term, 120::BIGINT AS weight FROM supplier
""")
def package_read_back(spark, sf_dir):
    """A package with a manifest, a CSV of rows and a CSV of search terms, written from a table, read and put together again."""
    s = table(spark, sf_dir, "supplier")
    root = st.shared_folder(spark, "package")
    items = s.select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"), F.lit("herb").alias("type"))
    terms = s.select(F.col("s_suppkey").cast("string").alias("item_code"), F.concat(F.lit("w"), "s_nationkey").alias("term"), F.lit("120").alias("weight"))
    records.write_package(spark, root, {"csv/items.csv": (items, "knowledge_items_v1"), "csv/terms.csv": (terms, "search_terms_v1")})
    package = records.read_package(spark, root)
    rows = records.attach_terms(package["rows"], package["terms"])
    first = F.get("package_terms", F.lit(0))
    got = (F.try_element_at("record", F.lit(k)).alias(k) for k in ("code", "name", "type"))
    return rows.select(*got, first["term"].alias("term"), first["weight"].cast("long").alias("weight"))
